"""Snapshot changes against brute force, with repeats, late deliveries, nulls and clashing columns."""

import random
from datetime import datetime, timedelta

import pytest

from codeloom.operators.snapshots import _xx3, snapshot_changes, valid_rows
from pyspark.sql import functions as F

SCHEMA = "snapshot_no int, id long, delivered_at timestamp, key string, content_hash string, status string, k1 string, bucket int"


def brute(rows):
    last = {}
    for r in rows:
        if None in (r[0], r[1], r[3]):
            continue
        at = (r[2] is not None, r[2] or datetime.min, (r[5] or "").strip().lower(), r[3], r[4] or "")
        if (r[0], r[1]) not in last or at > last[r[0], r[1]][0]:
            last[r[0], r[1]] = (at, r)
    state = {}
    for (n, _), (_, r) in last.items():
        if (r[5] or "").strip().lower() == "active":
            h = (r[4] or "-").strip().lower().removeprefix("sha256:")
            key = r[3].strip().replace("\\", "/").removeprefix("./")
            state.setdefault(n, {}).setdefault(key, set()).add(h)
    numbers = sorted({r[0] for r in rows if r[0] is not None})
    out = set()
    for a, b in zip(numbers, numbers[1:]):
        old, new = state.get(a, {}), state.get(b, {})
        for k in old.keys() | new.keys():
            if k not in old:
                out.add((b, k, "added"))
            elif k not in new:
                out.add((b, k, "removed"))
            elif old[k] != new[k]:
                out.add((b, k, "changed"))
    return out


def made(seed, n=300, snapshots=(1, 2, 4), change=0.2):
    rng = random.Random(seed)
    rows, hashes = [], {i: f"h{i}" for i in range(n)}
    at = datetime(2026, 1, 1)
    for s in snapshots:
        for i in range(n):
            if rng.random() < change:
                hashes[i] = f"h{rng.randrange(10**6)}"
            if rng.random() < change / 2:
                continue
            key = rng.choice(["{}", " {}", "./{}", "{}\t"]).format(f"a/b{i}.py#f{i}")
            h = rng.choice(["{}", "sha256:{}", "{} "]).format(hashes[i])
            status = rng.choice(["active", "Active", "active ", "active", "deleted"])
            row = (s, i, at + timedelta(hours=rng.randrange(50)), key, h, status, "x", 7)
            rows.append(row)
            if rng.random() < 0.2:
                rows.append(row)
            if rng.random() < 0.1:
                rows.append((*row[:2], row[2] + timedelta(hours=99), row[3], "other", "active", None, None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,bucket,cells", [(1, 2048, 384), (2, 64, 96), (3, 300, 12)])
def test_equals_brute_force(spark, seed, bucket, cells):
    rows = made(seed)
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), bucket_rows=bucket, cells=cells)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert got.columns == ["snapshot_no", "key", "change_kind"]


def test_buckets_that_never_peel_are_compared_row_by_row(spark):
    rows = made(5, n=400, change=0.9)
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), bucket_rows=4096, cells=12, rounds=1)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_nulls_and_empty(spark):
    t = datetime(2026, 1, 1)
    rows = [(1, 1, t, "a#x", None, "active", None, None), (2, 1, None, "a#x", None, "active", None, None), (2, 2, t, None, "h", "active", None, None), (None, 3, t, "a#z", "h", "active", None, None), (2, 4, t, "  ", "h", None, None, None), (2, None, t, "a#q", "h", "active", None, None)]
    assert snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect() == []
    assert snapshot_changes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert snapshot_changes(spark.createDataFrame(rows[:1], SCHEMA)).collect() == []


def test_a_hot_key_does_not_matter(spark):
    t = datetime(2026, 1, 1)
    rows = [(s, i, t, "hot#k" if i % 3 == 0 else f"a#{i}", "h" if s == 1 or i else "g", "active", None, None) for s in (1, 2) for i in range(600)]
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, "hot#k", "changed")}


def test_latest_delivery_holds(spark):
    t = datetime(2026, 1, 1)
    rows = [(1, 1, t, "a#x", "old", "active", None, None), (1, 1, t + timedelta(1), "a#x", "new", "deleted", None, None)]
    assert [tuple(r) for r in valid_rows(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 1, "a#x", "new", "deleted")]


def test_python_hash_is_sparks(spark):
    rng = random.Random(4)
    rows = [tuple(rng.randrange(-(2**63), 2**63) for _ in range(3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long").select("a", "b", "c", F.xxhash64("a", "b", "c").alias("h"))
    assert all(_xx3(r.a, r.b, r.c) == r.h for r in df.collect())

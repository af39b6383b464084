"""What changed between full snapshots, found by invertible Bloom lookup tables.

Each snapshot is summed up, per hash bucket, in a small table of cells; a row adds its key and its value
hash into three cells. Subtracting the tables of two snapshots cancels every row that both hold, so that
only differing rows remain, and these are peeled off one by one. What moves between machines is the
cells, not the rows: about a fifth of the rows' number, whatever their width.
"""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import normal_hash, normal_key, normal_word
from codeloom.plans.lineage import cut

HASHES = 3
_U64 = (1 << 64) - 1


def valid_rows(snapshots: DataFrame) -> DataFrame:
    """Of rows with the same (snapshot_no, id) the one delivered last: snapshot_no, id, key, content_hash, status.

    Rows without snapshot_no, id or key are dropped. A missing delivered_at counts as the earliest; among equally
    late deliveries the one with the greatest (status, key, content_hash) holds, so that a result doesn't depend on row order.
    """
    last = F.max(F.struct(F.col("delivered_at"), normal_word(F.col("status")).alias("status"), F.col("key"), F.col("content_hash"))).alias("r")
    return (
        snapshots.where(F.col("snapshot_no").isNotNull() & F.col("id").isNotNull() & F.col("key").isNotNull())
        .groupBy("snapshot_no", "id")
        .agg(last)
        .select("snapshot_no", "id", normal_key(F.col("r.key")).alias("key"), normal_hash(F.col("r.content_hash")).alias("content_hash"), F.col("r.status").alias("status"))
    )


def _peel(cells: dict[int, list[int]], width: int, hash_cells) -> tuple[list[tuple[int, int, int, int]], bool]:
    """Recovered (k1, k2, value, sign) of one bucket, and whether every cell came out as nothing and the bucket's digest came out again.

    The digest is the signed sum of a part of the check sums: each row stands once in the first third of the table, so it is the
    sum over that before anything is peeled, and it must be that of the recovered rows.
    """
    found, queue = [], list(cells)
    digest = sum(c[5] for i, c in cells.items() if i < width // HASHES)
    while queue:
        c = cells.get(queue.pop())
        if c is None or abs(c[0]) != 1:
            continue
        sign, k1, k2, v, check, total = c
        at, own, part = hash_cells(k1, k2, v, width)
        if own != check or part * sign != total:
            continue
        found.append((k1, k2, v, sign))
        digest -= sign * part
        for i in at:
            d = cells.setdefault(i, [0, 0, 0, 0, 0, 0])
            d[0] -= sign
            d[1] ^= k1
            d[2] ^= k2
            d[3] ^= v
            d[4] ^= own
            d[5] -= sign * part
            if any(d):
                queue.append(i)
            else:
                del cells[i]
    return found, not cells and digest == 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def snapshot_changes(snapshots: DataFrame, bucket_rows: int = 2048, cells: int = 384, rounds: int = 6, broadcast_keys: int = 500_000) -> DataFrame:
    """snapshot_no, key, change_kind: keys added, removed or changed per snapshot against the one before it by number, see change_kinds.

    Found keys are 128 bits; their spelling comes from the rows that hold them. Where at most broadcast_keys were found, the rows of other keys are
    left out before any is shuffled; beyond that all spellings are, with the same result.
    """
    kinds = change_kinds(snapshots, bucket_rows, cells, rounds)
    keys = kinds.select("k1", "k2").distinct()
    names = snapshots.where("key is not null").select(normal_key(F.col("key")).alias("key")).where("key is not null")
    names = names.select("key", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"))
    if kinds.count() <= broadcast_keys:
        names = names.join(F.broadcast(keys), ["k1", "k2"], "left_semi")
    return kinds.join(names.distinct(), ["k1", "k2"]).select("snapshot_no", "key", "change_kind")


def change_kinds(snapshots: DataFrame, bucket_rows: int = 2048, cells: int = 384, rounds: int = 6) -> DataFrame:
    """snapshot_no, k1, k2, change_kind: changes by the 128-bit hash of the key, written to the shared folder; nothing stays cached.

    snapshots: snapshot_no, id, delivered_at, key, content_hash, status; other columns are not read.
    A key is present in a snapshot if a valid row with it is active. If several active rows of a snapshot have the
    same key, the smallest and the greatest of their hashes are compared. A missing hash equals a missing hash.
    The first snapshot has no changes; an empty table gives no rows. bucket_rows: rows per bucket, at most about;
    cells: cells of a bucket's table in the first round, four times as many in each further one for buckets that
    can't be read off; what remains after the last round is compared row by row.
    """
    spark = snapshots.sparkSession
    named = valid_rows(snapshots).where((F.col("status") == "active") & F.col("key").isNotNull())
    value = F.xxhash64(F.coalesce("content_hash", F.lit("-")))
    cached = (
        named.groupBy("snapshot_no", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"))
        .agg(F.min(value).alias("a"), F.max(value).alias("z"))
        .select("snapshot_no", "k1", "k2", F.xxhash64("a", "z").alias("v"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    sizes = {r["snapshot_no"]: r["count"] for r in cached.groupBy("snapshot_no").count().collect()}  # one row per snapshot
    numbers = sorted({r["snapshot_no"] for r in snapshots.select("snapshot_no").where("snapshot_no is not null").distinct().collect()})
    schema = "snapshot_no int, k1 long, k2 long, change_kind string"
    if len(numbers) < 2:
        cached.unpersist()
        return spark.createDataFrame([], schema)
    buckets = max(1, -(-max(sizes.values(), default=1) // bucket_rows))
    # the step from a snapshot to the next one by number, as (number, step, sign)
    steps = spark.createDataFrame(
        [(n, n, 1) for n in numbers[1:]] + [(n, after, -1) for n, after in zip(numbers, numbers[1:])],
        "snapshot_no int, step int, sign int",
    )
    rows = cached.withColumn("snapshot_no", F.col("snapshot_no").cast("int")).withColumn("bucket", F.pmod(F.col("k1"), F.lit(buckets)).cast("int"))
    found, width, todo = [], cells, None
    for _ in range(rounds):
        mine = rows if todo is None else None
        # one table of cells per snapshot; only the cells are subtracted
        if mine is not None:
            tables = _tables(mine, width).join(F.broadcast(steps), "snapshot_no")
        else:
            # a failed (step, bucket) needs the rows of both snapshots of the step
            part = rows.join(F.broadcast(steps), "snapshot_no").join(todo, ["step", "bucket"], "left_semi")
            tables = _tables(part, width, ("step", "sign", "bucket"))
        diff = (
            tables.groupBy("step", "bucket", "cell")
            .agg(
                F.sum(F.col("n") * F.col("sign")).alias("n"),
                F.bit_xor("x1").alias("x1"),
                F.bit_xor("x2").alias("x2"),
                F.bit_xor("xv").alias("xv"),
                F.bit_xor("xc").alias("xc"),
                F.sum(F.col("total") * F.col("sign")).alias("total"),
            )
            .where("n <> 0 or x1 <> 0 or x2 <> 0 or xv <> 0 or xc <> 0 or total <> 0")
        )
        peeled = cut(diff.groupBy("step", "bucket").applyInPandas(_peeler(width), "step int, bucket int, k1 long, k2 long, v long, sign int"))
        todo = peeled.where("sign = 0").select("step", "bucket")
        found.append(peeled.where("sign <> 0"))
        if todo.isEmpty():
            todo = None
            break
        width *= 4
    if todo is not None:  # compare what is left row by row
        left = rows.join(F.broadcast(steps), "snapshot_no").join(todo, ["step", "bucket"], "left_semi")
        found.append(left.groupBy("step", "bucket", "k1", "k2", "v").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0").select("step", "bucket", "k1", "k2", "v", "sign"))
    all_found = found[0]
    for f in found[1:]:
        all_found = all_found.unionByName(f)
    kinds = all_found.groupBy("step", "k1", "k2").agg(F.min("sign").alias("lo"), F.max("sign").alias("hi"))
    kind = F.when(F.col("lo") == F.col("hi"), F.when(F.col("hi") == 1, "added").otherwise("removed")).otherwise("changed")
    out = cut(kinds.select(F.col("step").alias("snapshot_no"), "k1", "k2", kind.alias("change_kind")))
    cached.unpersist()
    return out


def _tables(rows: DataFrame, width: int, by: tuple[str, ...] = ("snapshot_no", "bucket")) -> DataFrame:
    third = width // HASHES
    check = F.xxhash64("k1", "k2", "v")
    part = F.shiftrightunsigned(F.col("check"), 33)
    # three cells from three disjoint runs of bits of the check sum and of the second key hash, one in each third of the table
    places = F.array(
        F.pmod(F.shiftrightunsigned(F.col("check"), 1), F.lit(third)).cast("int"),
        (F.pmod(F.shiftrightunsigned(F.col("k2").bitwiseXOR(F.shiftrightunsigned(F.col("check"), 21)), 1), F.lit(third)) + third).cast("int"),
        (F.pmod(F.shiftrightunsigned(F.col("k1").bitwiseXOR(F.shiftleft(F.col("check"), 17)), 3), F.lit(third)) + 2 * third).cast("int"),
    )
    return (
        rows.withColumn("check", check)
        .select(*by, "k1", "k2", "v", "check", part.alias("part"), F.explode(places).alias("cell"))
        .groupBy(*by, "cell")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor("k1").alias("x1"),
            F.bit_xor("k2").alias("x2"),
            F.bit_xor("v").alias("xv"),
            F.bit_xor("check").alias("xc"),
            F.sum("part").alias("total"),
        )
    )


def _peeler(width: int):
    third = width // HASHES

    def place(k1: int, k2: int, v: int, width: int) -> tuple[list[int], int, int]:
        check = _xx3(k1, k2, v)
        u = check & _U64
        at = [
            (u >> 1) % third,
            (((k2 & _U64) ^ (u >> 21)) >> 1) % third + third,
            (((k1 & _U64) ^ ((u << 17) & _U64)) >> 3) % third + 2 * third,
        ]
        return at, check, u >> 33

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        step, bucket = int(pdf["step"].iloc[0]), int(pdf["bucket"].iloc[0])
        cells = {int(c): [int(n), int(a), int(b), int(v), int(x), int(t)] for c, n, a, b, v, x, t in zip(pdf["cell"], pdf["n"], pdf["x1"], pdf["x2"], pdf["xv"], pdf["xc"], pdf["total"])}
        found, whole = _peel(cells, width, place)
        if not whole:
            found = [(0, 0, 0, 0)]
        return pd.DataFrame([(step, bucket, *f) for f in found], columns=["step", "bucket", "k1", "k2", "v", "sign"])

    return peel


_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _xx_long(value: int, seed: int) -> int:
    """The public XXH64 of one 8-byte integer, as Spark's xxhash64 computes it for a long."""
    h = (seed + _P5 + 8) & _U64
    k = ((value & _U64) * _P2) & _U64
    k = ((k << 31) | (k >> 33)) & _U64
    h ^= (k * _P1) & _U64
    h = ((((h << 27) | (h >> 37)) & _U64) * _P1 + _P4) & _U64
    h ^= h >> 33
    h = (h * _P2) & _U64
    h ^= h >> 29
    h = (h * _P3) & _U64
    return h ^ (h >> 32)


def _xx3(k1: int, k2: int, v: int) -> int:
    return _signed(_xx_long(v, _xx_long(k2, _xx_long(k1, 42))))

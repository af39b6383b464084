import os

import pytest

from codeloom.functions.markdown import purpose, splice_section, split_sections
from codeloom.operators import baseline_ops as B
from codeloom.operators import impact, ledger, resolve, verify
from codeloom.sources import history, sinks
from pyspark.sql import functions as F

H = "a" * 64
ENTRY = "wiki_path string, symbol_key string, hash string, extraction string, provenance string"


def test_snapshots_and_two_writers(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert sinks.current(spark, folder) is None
    a = sinks.write_snapshot(spark.range(3), folder)
    assert sinks.publish(spark, folder, a, None) and sinks.current(spark, folder) == a
    b = sinks.write_snapshot(spark.range(5), folder)
    assert not sinks.publish(spark, folder, b, None) and sinks.publish(spark, folder, b, a)
    assert spark.read.parquet(sinks.current(spark, folder)).count() == 5
    assert not [f for f in os.listdir(folder) if f.startswith(".draft")]


def test_updates_start_anew_after_a_lost_race(spark, tmp_path):
    folder = str(tmp_path / "t")
    raced = []

    def more(old):
        if len(raced) == 1:  # another writer comes between
            raced.append(1)
            assert sinks.publish(spark, folder, sinks.write_snapshot(spark.range(100, 103), folder), sinks.current(spark, folder))
        raced.append(1)
        return spark.range(1) if old is None else old.unionByName(spark.range(7, 8))

    sinks.update(spark, folder, more)
    sinks.update(spark, folder, more)
    assert sorted(r[0] for r in spark.read.parquet(sinks.current(spark, folder)).collect()) == [7, 100, 101, 102]
    with pytest.raises(TimeoutError):
        sinks.update(spark, folder, lambda old: old, tries=0)
    again = spark.createDataFrame([(1, "b", None), (1, "a", "x"), (None, "q", "x"), (2, None, None)], "k int, v string, w string")
    assert sorted(map(tuple, sinks.rebuild(again, ["k"]).collect())) == [(1, "a", "x"), (2, None, None)]


def test_merges_and_exports(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.insert_or_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    pages = spark.createDataFrame([("w/a/b.md", "[x](c/d/e.md#s/t) [y](https://z/q.md) [z](f.md) [u](../u/v.md) [w](./a/b.md) [d](1/2/3/4/5/6/7/8/9/10.md)")], "wiki_path string, text string")
    sinks.export_pages(pages, str(tmp_path / "out"), 2)
    r = spark.read.json(str(tmp_path / "out")).first()
    assert r["name"] == "w--a--b.md" and r["text"] == "[x](c--d--e.md#s/t) [y](https://z/q.md) [z](f.md) [u](../u/v.md) [w](./a--b.md) [d](1--2--3--4--5--6--7--8--9--10.md)"


def test_history(spark, tmp_path):
    (tmp_path / "log").write_text("@100\n\na.py\nb.py\n@200\n\na.py\n")
    log = history.read_name_only_log(spark, str(tmp_path / "log"))
    assert {tuple(r) for r in history.churn(log).collect()} == {("a.py", 2), ("b.py", 1)}
    assert {tuple(r) for r in history.path_times(log).collect()} == {("a.py", 100, 200), ("b.py", 100, 100)}
    assert [r[0] for r in history.changed_paths(log.where("path = 'a.py'")).collect()] == ["a.py"]
    (tmp_path / "led").write_text('{"a": 1}\nnot json\n')
    led = history.read_ledger(spark, str(tmp_path / "led"), "a int, _corrupt_record string").collect()
    assert sorted((r["a"] or 0, r["_corrupt_record"]) for r in led) == [(0, "not json"), (1, None)]


def test_baseline_operations(spark):
    b = spark.createDataFrame([("w", "a.ts#f", H, "ts-v1", "accepted"), ("w", "a.ts#g", H, "ts-v1", "inferred")], ENTRY)
    s = spark.createDataFrame([("a.ts#f", "b" * 64), ("n.ts#g", "c" * 64)], "key string, content_hash string")
    pair = lambda *rows: spark.createDataFrame(list(rows), "wiki_path string, symbol_key string")
    assert {tuple(r) for r in B.accept(b, pair(("w", "a.ts#f"), ("w", "gone#x"), ("v", "n.ts#g")), s).collect()} == {("w", "a.ts#f", "b" * 64, "ts-v1", "accepted"), ("w", "a.ts#g", H, "ts-v1", "inferred"), ("v", "n.ts#g", "c" * 64, "ts-v1", "accepted")}
    moved = B.move(b, spark.createDataFrame([("w", "a.ts#g", "n.ts#g"), ("w", "a.ts#f", "n.ts#g")], "wiki_path string, symbol_key string, moved_to string"))
    assert [r["symbol_key"] for r in moved.collect()] == ["n.ts#g"]
    assert [r["symbol_key"] for r in B.remove(b, pair(("w", "a.ts#f"))).collect()] == ["a.ts#g"]
    assert {r["wiki_path"] for r in B.relocate(b, spark.createDataFrame([("w", "z")], "wiki_path string, new_path string")).collect()} == {"z"}
    states = spark.createDataFrame([("w", "a.ts#f", "changed"), ("w", "a.ts#g", "deleted")], "wiki_path string, symbol_key string, state string")
    assert {r["symbol_key"]: r["hash"] for r in B.advance(b, states, s).collect()} == {"a.ts#f": "b" * 64, "a.ts#g": H}
    bad = spark.createDataFrame([("", "a.ts#f", H, "ts-v1", "accepted"), ("../w", "nokey", "x", None, "guess"), ("w", "a.ts#f", H, "py-v1", "accepted"), ("d", "a.ts#f", H, "ts-v1", "accepted"), ("d", "a.ts#f", H, "ts-v1", "accepted")], ENTRY)
    got = {(r["wiki_path"], r["issue"]) for r in B.validate(bad).collect()}
    assert got == {("", "no_path"), ("../w", "path_leaves_root"), ("../w", "malformed_key"), ("../w", "malformed_hash"), ("../w", "unknown_provenance"), ("w", "unknown_extraction"), ("d", "duplicate")}
    assert B.validate(b).collect() == [] and B.canonical_lines(b).first()[0].startswith('{"wiki_path":"w","symbol_key":"a.ts#f"')


def test_problems_of_a_baseline(spark):
    b = spark.createDataFrame([("w", "a.ts#f", H, "ts-v1", "accepted"), ("w", "a.ts#g", H, "ts-v1", "inferred")], ENTRY)
    anchored = spark.createDataFrame([("w", "a.ts#f"), ("v", "a.ts#g")], "wiki_path string, symbol_key string")
    assert {tuple(r) for r in verify.baseline_problems(b, anchored).collect()} == {("w", "baseline_entry_without_anchor", "a.ts#g")}
    bad = b.unionByName(spark.createDataFrame([("w", "b.ts#x", H, "ts-v9", "accepted"), ("", "b.ts#x", H, "ts-v1", "accepted")], ENTRY))
    assert {tuple(r)[:2] for r in verify.baseline_problems(bad, anchored).collect()} == {("w", "unsupported_baseline_algorithm"), ("", "invalid_documentation_baseline")}
    assert verify.baseline_problems(b.limit(0), anchored.limit(0)).collect() == []


def test_sets_and_order_of_rationales(spark):
    a, b = (spark.createDataFrame(x, "k string") for x in ([("x",), ("y",), ("y",), (None,)], [("y",), ("z",), (None,)]))
    assert {tuple(r) for r in ledger.set_differences(a, b, "k").collect()} == {("x", "left"), ("z", "right")} and ledger.set_differences(a.limit(0), b.limit(0), "k").collect() == []
    r = spark.createDataFrame([(2, 5, "todo", "b"), (2, 1, "why", "a"), (1, 9, "note", "c"), (3, 1, "hack", "d"), (None, 1, "hack", "e")], "file_id long, line int, kind string, text string")
    f = spark.createDataFrame([(1, "b.ts", "active"), (2, "a.ts", "active"), (3, "c.ts", "deleted")], "id long, path string, status string")
    assert [tuple(x)[:3] for x in resolve.rationales_of_files(r, f).collect()] == [("a.ts", 1, 1), ("a.ts", 2, 5), ("b.ts", 1, 9)]


def test_previews(spark):
    duty = spark.createDataFrame([("w", "a#f", "agent"), ("w", "a#g", "agent"), ("w", "b#h", "agent")], "wiki_path string, symbol_key string, assignee string")
    base = spark.createDataFrame([("w", "a#f", "1"), ("w", "a#g", "2")], "wiki_path string, symbol_key string, hash string")
    fresh = spark.createDataFrame([("a#f", "9")], "key string, content_hash string")
    got = impact.working_tree_preview(duty, base, fresh, spark.createDataFrame([("a",)], "path string"))
    assert {tuple(r) for r in got.collect()} == {("w", "a#f", "changed"), ("w", "a#g", "deleted")}


def test_sections(spark):
    t = "intro\n## A\nx\n```\n## no\n```\n## B\ny\n"
    assert [x[0] for x in split_sections(t)] == ["", "A", "B"] and "".join(t[a:z] for _, a, z in split_sections(t)) == t
    assert splice_section(t, "B", "## B\nz\n").endswith("## B\nz\n") and splice_section(t, "C", "q") == t
    assert purpose("---\ntitle: x\n---\n# T\n\nThe first\nsentence.\n\nMore") == "The first sentence." and purpose("# T") is None
    assert spark.range(1).select(F.lit(1)).count() == 1

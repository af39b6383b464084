from datetime import datetime

from codeloom.operators.orphans import direct_symbol_orphans, orphan_cascade, orphan_report, symbol_references, workspace_orphans

CALLS = "file_id long, caller_key string, callee_name string, resolved_callee_key string, line int, confidence string, recorded_at timestamp, symbol_key string"
ANCHORS = "doc_page_id long, wiki_path string, owner string, page_anchors array<string>, section_anchors array<struct<section_slug:string,heading_text:string,symbol_keys:array<string>,anchor_marker_offset:int,in_manual_block:boolean>>, recorded_at timestamp"
SYMBOLS = "id long, file_id long, key string, status string, recorded_at timestamp, reason string"


def day(m, d=1):
    return datetime(2026, m, d)


def found(spark, calls, anchors, symbols):
    got = cascade(spark, [(1, "a", "active")], symbols, [(1, "w")], calls, anchors)
    return {tuple(r)[:4] for r in direct_symbol_orphans(got).collect()}


def cascade(spark, files, symbols, pages, calls, anchors):
    return workspace_orphans(
        spark.createDataFrame(files, "id long, path string, status string"), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame([], SYMBOLS),
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(pages, "id long, wiki_path string"), spark.createDataFrame(anchors, ANCHORS),
    )


def call(key, at, caller="c#c"):
    return (1, caller, "n", key, 1, "extracted", at, "x")


def test_reasons_spellings_and_nulls(spark):
    symbols = [(1, 1, "a/b.py#live", "active", day(2), None), (2, 1, "a/b.py#gone", "deleted", day(1), None), (3, 1, "a/b.py#back", "deleted", day(1), None), (4, 1, "a/b.py#back", "active", day(1), None), (5, None, None, "active", None, None), (6, 1, "a/b.py#always", "active", None, None)]
    calls = [
        call("a/b.py#live", day(3)), call("./a/b.py#live", day(1)), call(" a\\b.py#live\t", day(1)), call("a/b.py#gone", day(3)), call("a/b.py#back", day(3)),
        call("A/b.py#live", day(3)), call(None, day(3)), call("", day(3)), call("  ", day(3)), call("a/x/../b.py#live", day(1)), call("a/b.py#always", day(1)), call("a//b.py#nope", None),
    ]
    anchors = [(1, "w", None, ["a/b.py#gone", None, ""], [("s", "h", ["q#q", None], 1, False), ("s", "h", [], 1, False)], day(4)), (1, "w", None, None, None, day(4)), (1, "w", None, [], [], day(4))]
    assert found(spark, calls, anchors, symbols) == {
        ("calls", "2026-01", "a/b.py#live", "late"), ("calls", "2026-03", "a/b.py#gone", "deleted"), ("calls", "2026-03", "A/b.py#live", "missing"), ("calls", None, "a/b.py#nope", "missing"),
        ("page_anchors", "2026-04", "a/b.py#gone", "deleted"), ("section_anchors", "2026-04", "q#q", "missing"),
    }


def test_months_are_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp_micros(1767225600000000) as recorded_at, 'x#y' as resolved_callee_key")  # 2026-01-01 00:00 UTC
        refs = symbol_references(df, spark.createDataFrame([], ANCHORS))
        assert refs.first()["ref_month"] == "2026-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty_tables(spark):
    assert found(spark, [], [], []) == set()


RECORDS = "table string, key string, is_active boolean, active_at timestamp"
REFERENCES = "table string, key string, parent string, parent_key string, period string, first_at timestamp, n_refs long"


def ref(key, parent_key, table="t", first=None):
    return (table, key, "t", parent_key, "p", first, 1)


def test_cascade_reaches_the_fixpoint_and_ends_on_cycles(spark):
    records = spark.createDataFrame([("t", k, k != "z", day(5) if k == "y" else None) for k in "bcdexyz"], RECORDS)
    refs = [ref("b", "missing"), ref("c", "b"), ref("d", "c"), ref("d", "e"), ref("x", "y", first=day(1)), ref("y", "x"), ref("b", "d"), ref("e", None), ref("e", "z"), ref(None, "d", "leaf"), ref(None, "y", "leaf", day(1)), ref(None, "y", "leaf", day(9))]
    df = spark.createDataFrame(refs, REFERENCES)
    got = {(r["table"], r["key"], r["parent_key"], r["kind"], r["reason"], r["level"]) for r in orphan_cascade(records, df).collect()}
    assert got == {
        ("t", "b", "missing", "direct", "missing", 0), ("t", "e", "z", "direct", "deleted", 0), ("t", "x", "y", "direct", "late", 0), ("leaf", None, "y", "direct", "late", 0),
        ("t", "c", "b", "inherited", "orphaned", 1), ("t", "d", "c", "inherited", "orphaned", 2), ("t", "d", "e", "inherited", "orphaned", 1), ("t", "b", "d", "inherited", "orphaned", 2), ("leaf", None, "d", "inherited", "orphaned", 2),
    }
    assert {r["kind"] for r in orphan_cascade(records, df, depth=0).collect()} == {"direct"}
    assert {r["level"] for r in orphan_cascade(records, df, depth=1).collect()} == {0, 1}
    assert orphan_cascade(records.limit(0), df.limit(0)).collect() == []


def test_workspace_cascade(spark):
    """A deleted file's symbol and a deleted class's methods pass their state on to what refers to them; so does a missing page."""
    files = [(1, "a", "active"), (2, "b", "deleted")]
    symbols = [
        (1, 1, "a#x", "active", day(1), None), (2, 2, "b#y", "active", day(1), None), (3, 1, "a#C", "deleted", day(1), None), (4, 1, "a#C.m", "active", day(1), None), (5, 1, "a#C.m.n", "active", day(1), None), (6, None, "s#s", "active", day(1), None),
    ]
    calls = [call("b#y", day(2), "a#x"), call("c#z", day(2), "a#x"), call("a#C.m.n", day(2), "a#x"), call("a#x", day(2), "a#C.m"), call("s#s", day(2), None)]
    anchors = [(1, "w", None, ["a#x"], None, day(2)), (9, "v", None, ["a#x", None, " "], [("s", "h", ["a#x", ""], 1, False), None], day(3)), (None, "u", None, ["a#x"], None, day(3))]
    found = cascade(spark, files, symbols, [(1, "w")], calls, anchors)
    got = {(r["table"], r["key"], r["parent_key"], r["period"], r["n_refs"], r["kind"], r["reason"], r["level"]) for r in found.collect()}
    assert got == {
        ("symbols", "b#y", "2", "2026-01", 1, "direct", "deleted", 0), ("symbols", "a#C.m", "a#C", "2026-01", 1, "direct", "deleted", 0), ("symbols", "a#C.m.n", "a#C.m", "2026-01", 1, "inherited", "orphaned", 1),
        ("calls", None, "b#y", "2026-02", 1, "inherited", "orphaned", 1), ("calls", None, "c#z", "2026-02", 1, "direct", "missing", 0), ("calls", None, "a#C.m.n", "2026-02", 1, "inherited", "orphaned", 2),
        ("callers", None, "a#C.m", "2026-02", 1, "inherited", "orphaned", 1), ("extracted_anchors", "9", "9", "2026-03", 1, "direct", "missing", 0),
        ("page_anchors", None, "9", "2026-03", 1, "inherited", "orphaned", 1), ("section_anchors", None, "9", "2026-03", 1, "inherited", "orphaned", 1),
    }
    report = {tuple(r) for r in orphan_report(found).collect()}
    assert ("calls", "symbols", "2026-02", "inherited", "orphaned", 2, 2, 2, 2) in report and len(report) == 9

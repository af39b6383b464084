"""Workspace operators on small literal tables, in natural and in shuffled order."""

import random

import pytest

from codeloom.functions import paths as P
from codeloom.functions import text as X
from codeloom.functions.keys import normal_hash, normal_key
from codeloom.functions.markdown import front_matter, mask_code, open_fence, parse, parse_pages
from codeloom.operators import activity, graph, ledger, planning, resolve, search, status, verify
from codeloom.plans import workspace_queries
from codeloom.sources import scan
from pyspark.sql import functions as F


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_keys(spark):
    got = column(spark, ["a/b.py#f", " ./a//b.py#f\t", "a\\.\\b.py#F g", "a/../b.py#x", "../b#x", "", "  ", None, "#x", "a/b", "a#x#y"], normal_key)
    assert got == ["a/b.py#f", "a/b.py#f", "a/b.py#F g", "b.py#x", "../b#x", None, None, None, "#x", "a/b", "a#x#y"]
    assert column(spark, ["AB", " sha256:Ab ", "SHA256: ab", None, ""], normal_hash) == ["ab", "ab", "ab", None, ""]


@pytest.mark.parametrize(
    "pattern,path,hit",
    [
        ("**/*.test.*", "a/b.test.ts", True), ("**/*.test.*", "b.test.ts", True), ("docs/**", "docs/a", True), ("docs/**", "x/docs/a", False), ("dist/", "a/dist/b", True), ("dist/", "dist", False), ("*.js", "a/b.js", True), ("/a.js", "b/a.js", False),
        ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/d/c", False), ("a/**/c", "a/c", True), ("x?z", "xyz", True), ("[ab].py", "a.py", True), ("[!ab].py", "a.py", False), ("build", "build/x/y", True),
    ],
)
def test_globs(spark, pattern, path, hit):
    assert column(spark, [path], lambda c: P.matches_any(c, [pattern])) == [hit]


def test_paths(spark):
    ps = ["src/a.ts", "x/__tests__/fixtures/b.ts", "a/b.spec.js", "a/tools/x.py", "docs/x.md", "a/test_x.py", "noext", ".env"]
    assert column(spark, ps, P.path_role) == ["product", "fixture", "test", "tooling", "docs", "test", "product", "product"]
    assert column(spark, ps, P.narrow_test) == [False, True, True, False, False, True, False, False]
    assert column(spark, ps, P.extension) == ["ts", "ts", "js", "py", "md", "py", "", ""]
    assert column(spark, ps[:1] + ps[6:], P.dir_name) == ["src", "", ""]
    assert column(spark, ["a.png", "yarn.lock", "x.MIN.js", "noext", "node_modules/a.js", "a.js"], P.denied) == ["extension", "name", "minified", "no extension", "ignored", None]
    assert column(spark, ["a/b.ts#f", "#f", "x", None], P.key_path) == ["a/b.ts", None, None, None]
    assert column(spark, ["w/quickstart.md", "w/topics/a.md", "w/topics/index.md", "w/a.md", "w/tasks.md", "w/f/b.md", "w/a/b/c.md", "w/x.mmd"], P.page_group) == ["Quickstart", "Concept topics", "Implementation reference", "Implementation reference", "Indexes & overviews", "Implementation reference", "Indexes & overviews", "Diagrams"]
    assert column(spark, ["x.md", "../y.md", "../../z.md", "./a/./b.md"], lambda c: P.resolve_relative(F.lit("w/p.md"), c)) == ["w/x.md", "y.md", "../z.md", "w/a/b.md"]


def test_texts(spark):
    assert column(spark, ["fooBar XMLParser a_b plain", "", None], X.split_identifiers) == ["fooBar foo Bar XMLParser XML Parser a_b a b plain", "", None]
    assert column(spark, ["Über  die Größe!", "A_b-C", None], X.slugify) == ["uber-die-groe", "a_b-c", None]
    assert column(spark, ["# T\n\nSome `code` and [link](x.md).\n<!-- c -->\n```\nx\n```\n> more_text"], X.plain_excerpt) == ["Some and link. more text"]
    long = "a" * 200 + " Needle " + "b" * 200
    got = column(spark, [long, "needle", "nothing here"], lambda c: X.snippet_around(c, "needle"))
    assert got[0] == "..." + "a" * 79 + " <<Needle>> " + "b" * 79 + "..." and got[1] == "<<needle>>" and got[2] == "nothing here"
    assert column(spark, ["abcde"], X.token_estimate) == [2]
    assert column(spark, ["// TODO: x\ty"], X.rationale_text) == ["TODO: x y"]
    assert column(spark, ["a\nb\nc\nd\ne"], lambda c: X.symbol_snippet(c, F.lit(3), F.lit(3), 1)) == ["b\nc\nd"]
    assert column(spark, ["0", "1", "5", "11", "99"], lambda c: X.bands(c.cast("int"), status.FAN_IN_BANDS)) == [0, 5, 10, 20, 20]
    assert column(spark, ["a\r\nb\rc"], X.normalize_eol) == ["a\nb\rc"]


def symbols(spark, rows):
    return spark.createDataFrame(rows, "id long, file_id long, key string, name string, kind string, signature string, start_line int, end_line int, content_hash string, status string")


def test_call_resolution(spark):
    s = symbols(spark, [(1, 1, "a#f", "f", "function", None, 1, 2, "h", "active"), (2, 2, "b#f", "f", "function", None, 1, 2, "h", "active"), (3, 2, "b#g", "g", "export", None, 1, 2, "h", "active"), (4, 3, "c#m", "m", "method", None, 1, 2, "h", "active"), (5, 3, "c#d", "d", "function", None, 1, 2, "h", "deleted")])
    calls = spark.createDataFrame([(1, "f"), (3, "f"), (3, "g"), (3, "m"), (3, "d"), (3, None)], "file_id long, callee_name string")
    got = {(r["file_id"], r["callee_name"]): r["callee_key"] for r in resolve.resolve_calls(calls, s).collect()}
    assert got == {(1, "f"): "a#f", (3, "f"): None, (3, "g"): "b#g", (3, "m"): None, (3, "d"): None, (3, None): None}


def test_innermost(spark):
    s = symbols(spark, [(1, 1, "a#C", "C", "class", None, 1, 900, "h", "active"), (2, 1, "a#C.m", "C.m", "method", None, 10, 20, "h", "active"), (3, 1, "a#C.n", "C.n", "method", None, 10, 15, "h", "active"), (4, 1, "a#x", "x", "method", None, 11, 12, "h", "deleted")])
    points = spark.createDataFrame([(1, 12), (1, 18), (1, 600), (1, 950), (2, 1), (None, 1), (1, 12)], "file_id long, line int")
    got = sorted((tuple(r) for r in resolve.innermost_symbol(points, s).select("line", "symbol_key").collect()), key=str)
    assert got == sorted([(12, "a#C.n"), (12, "a#C.n"), (18, "a#C.m"), (600, "a#C"), (950, None), (1, None), (1, None)], key=str)


def test_imports(spark):
    files = spark.createDataFrame([(1, "p/src/a.ts", "active"), (2, "p/src/b.ts", "active"), (3, "p/src/c/index.ts", "active"), (4, "q/m.py", "active"), (5, "q/n.py", "active"), (6, "q/src/x.rs", "active"), (7, "q/src/y.rs", "active")], "id long, path string, status string")
    contents = spark.createDataFrame([(1, 'import { b } from "./b";\nimport x from "./c";\nexport { y } from "react";\n'), (4, "from .n import f\nfrom . import g\nfrom os import path\n"), (6, "use crate::y::Y;\nuse std::io;\n")], "file_id long, content string")
    got = {tuple(r) for r in resolve.resolve_imports(resolve.imports(files, contents), files).select("from_file", "to_file").collect()}
    assert got == {("p/src/a.ts", "p/src/b.ts"), ("p/src/a.ts", "p/src/c/index.ts"), ("q/m.py", "q/n.py"), ("q/src/x.rs", "q/src/y.rs")}


def test_paired_tests(spark):
    p = spark.createDataFrame([("d/batch.ts", "product"), ("d/ba.ts", "product"), ("d/batch.test.ts", "test"), ("d/batch-repair.test.ts", "test"), ("e/x.test.ts", "test")], "path string, role string")
    got = {r["path"]: (r["disposition"], r["product_path"]) for r in resolve.paired_tests(p).collect()}
    assert got == {"d/batch.test.ts": ("test-paired", "d/batch.ts"), "d/batch-repair.test.ts": ("test-likely", "d/batch.ts"), "e/x.test.ts": ("test-orphan", None)}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_blast_radius(spark):
    e = spark.createDataFrame([("b", "a", True), ("c", "a", False), ("d", "b", True), ("d", "c", False), ("a", "d", True), ("e", "d", True)], "caller string, callee string, extracted boolean")
    got = [tuple(r) for r in graph.blast_radius(e, "a", 5, 100).collect()]
    assert got == [("b", 1, True, True, False), ("c", 1, False, True, False), ("d", 2, True, False, False), ("e", 3, True, False, False)]
    capped = graph.blast_radius(e, "a", 5, 2).collect()
    assert [r["caller"] for r in capped] == ["b", "c"] and all(r["truncated"] for r in capped)
    assert all(r["truncated"] for r in graph.blast_radius(e, "a", 1, 100).collect())
    assert graph.blast_radius(e, "zz").collect() == []


def test_components_and_communities(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(32)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[find(a)] = find(b)
    groups = {}
    for n in list(parent):
        groups.setdefault(find(n), []).append(n)
    want = {n: min(g) for g in groups.values() for n in g}
    shuffled = pairs[:]
    rng.shuffle(shuffled)
    assert {r[0]: r[1] for r in graph.components(edges(spark, shuffled)).collect()} == want
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    label = graph._propagate(sorted(near), {k: sorted(v) for k, v in near.items()}, 10)
    got = graph.communities(edges(spark, shuffled)).collect()
    assert {r["node"]: r["community"] for r in got} == label and all(r["sequential"] for r in got)
    big = graph.communities(edges(spark, pairs), largest=5).collect()
    assert {r["node"] for r in big} == set(label) and not all(r["sequential"] for r in big)
    assert graph.components(edges(spark, [])).collect() == []
    alone = graph.components(edges(spark, [("a", "a")]), spark.createDataFrame([("a",), ("z",)], "node string"))
    assert {tuple(r) for r in alone.collect()} == {("a", "a"), ("z", "z")}


def test_paths_and_trees(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")])
    paths = graph.simple_paths(e, spark.createDataFrame([("a",)], "node string"), 4)
    assert sorted(tuple(r["path"]) for r in paths.collect()) == [("a", "b"), ("a", "b", "c"), ("a", "b", "d")]
    assert sorted(tuple(r["path"]) for r in graph.maximal_paths(paths).collect()) == [("a", "b", "c"), ("a", "b", "d")]
    assert {r["node"]: r["n_paths"] for r in graph.path_centrality(paths).collect()} == {"a": 3, "b": 3, "c": 1, "d": 1}
    t = graph.directory_tree(spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",)], "path string"))
    assert {tuple(r) for r in t.collect()} == {("", "a", 2), ("a", "a/b", 1)}
    u = graph.unique_suffixes(spark.createDataFrame([("a/x.py",), ("b/x.py",), ("c/y.py",)], "path string"))
    assert {r["path"]: r["id"] for r in u.collect()} == {"a/x.py": "a/x.py", "b/x.py": "b/x.py", "c/y.py": "y.py"}
    hub = graph.joined_by_hub(spark.createDataFrame([("a", "h"), ("b", "h"), ("b", "g"), ("c", "g"), ("d", "k")], "node string, hub string"))
    assert {tuple(r) for r in hub.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}
    s = graph.strongest_edges(spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("a", "d", 2)], "src string, dst string, weight int"), 2)
    assert {tuple(r) for r in s.collect()} == {("a", "c"), ("a", "d")}


def test_partition_agreement(spark):
    m = spark.createDataFrame([("m1", "a"), ("m1", "b"), ("m2", "c"), ("m3", "z")], "module string, path string")
    f = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "node string, community string")
    got = {r["module"]: tuple(r)[1:] for r in graph.partition_agreement(m, f).collect()}
    assert got == {"m1": ("x", 1.0, 0), "m2": ("x", 1.0, 1), "m3": (None, -1.0, 0)}


def test_baseline(spark):
    b = spark.createDataFrame([("w", "a.ts#f", "h1", "ts-v1", "accepted"), ("w", "a.ts#g", "h2", "ts-v1", "accepted"), ("w", "old.ts#m", "h3", "ts-v1", "accepted"), ("w", "old.ts#n", "h4", "ts-v1", "accepted"), ("w", "a.ts#i", "h", "ts-v1", "inferred"), ("v", "old.ts#k", "h5", "ts-v1", "accepted"), ("w", "old.ts#k", "h5", "ts-v1", "accepted")], "wiki_path string, symbol_key string, hash string, extraction string, provenance string")
    s = spark.createDataFrame([("a.ts#f", "f", "h1"), ("a.ts#g", "g", "hx"), ("new.ts#m", "m", "h3"), ("p.ts#n", "n", "h4"), ("q.ts#n", "n", "h4"), ("new.ts#k", "k", "h5")], "key string, name string, content_hash string")
    duty = spark.createDataFrame([("w", k, "agent") for k in ("a.ts#f", "a.ts#g", "old.ts#m", "old.ts#n", "x#new", "old.ts#k")] + [("v", "old.ts#k", "human")], "wiki_path string, symbol_key string, assignee string")
    got = {(r["wiki_path"], r["symbol_key"]): (r["state"], r["moved_to"], r["cited"]) for r in ledger.evaluate_baseline(b, s, duty).collect()}
    assert got == {
        ("w", "a.ts#f"): ("clean", None, True), ("w", "a.ts#g"): ("changed", None, True), ("w", "old.ts#m"): ("moved", "new.ts#m", True), ("w", "old.ts#n"): ("deleted", None, True), ("w", "a.ts#i"): ("inferred", None, False),
        ("v", "old.ts#k"): ("deleted", None, True), ("w", "old.ts#k"): ("deleted", None, True), ("w", "x#new"): ("unbaselined", None, True),
    }


def test_plans_blocks_and_moves(spark):
    old = spark.createDataFrame([("a", "1", "active"), ("b", "1", "active"), ("c", "1", "deleted"), ("d", "1", "active"), ("e", "1", "deleted")], "path string, content_hash string, status string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("n", "9")], "path string, content_hash string")
    assert {tuple(r) for r in ledger.index_plan(old, new).collect()} == {("a", "unchanged"), ("b", "update"), ("c", "reactivate"), ("d", "delete"), ("e", "gone"), ("n", "insert")}
    assert {r["path"]: r["status"] for r in ledger.next_state(old, new).collect()} == {"a": "active", "b": "active", "c": "active", "d": "deleted", "e": "deleted", "n": "active"}
    at = "page string, start_offset int, content_hash string"
    got = ledger.reconcile_blocks(spark.createDataFrame([("p", 1, "h"), ("p", 5, "h"), ("p", 9, "g")], at), spark.createDataFrame([("p", 1, "h"), ("p", 7, "h"), ("p", 8, "h"), ("p", 9, "x")], at))
    assert {tuple(r)[1:] for r in got.collect()} == {(1, "h", "exact"), (7, "h", "moved"), (8, "h", "new"), (9, "x", "new")}
    gone = spark.createDataFrame([("o#f", 1, "f", "function", None, "h1"), ("o#g", 1, "g", "function", "s", "zz")], "key string, file_id long, name string, kind string, signature string, content_hash string")
    live = spark.createDataFrame([(1, "n#f", 2, "f", "function", None, "h1"), (2, "m#g", 3, "g", "function", "s", "yy")], "id long, key string, file_id long, name string, kind string, signature string, content_hash string")
    assert {tuple(r) for r in ledger.legacy_moves(gone, live).collect()} == {("o#f", "n#f"), ("o#g", "m#g")}
    sync = ledger.debt_sync(spark.createDataFrame([("w", "a", "changed", "human"), ("w", "b", "changed", "agent")], "wiki_path string, symbol_key string, event string, assignee string"), spark.createDataFrame([("w", "a", "changed", "agent"), ("w", "c", "deleted", "agent")], "wiki_path string, symbol_key string, event string, assignee string"))
    assert {(r["symbol_key"], r["action"]) for r in sync.collect()} == {("a", "promote"), ("b", "create"), ("c", "resolve")}


def test_eol_proofs(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    contents = spark.createDataFrame([(1, "a\r\nb"), (2, "a\r\nb"), (3, "a\nb"), (4, "x")], "file_id long, content string")
    files = spark.createDataFrame([(1, sha("a\nb")), (2, sha("a\r\nb")), (3, sha("a\r\nb")), (4, "?")], "id long, content_hash string")
    assert {tuple(r) for r in ledger.eol_migrations(contents, files).collect()} == {(1, "same"), (2, "raw"), (3, "crlf"), (4, "changed")}


PAGE = "---\ntitle: T\nowner: human\nanchors:\n  - a.ts#f\n  - b.ts#g\n---\n# Top\n\n## One `x`\n<!-- lw:anchors a.ts#f c.ts#h -->\n```\n## not a heading\n<!-- lw:anchors no#no -->\n```\n<!-- lw:manual:start -->\n## Über\n<!-- lw:anchors d#d -->\n<!-- lw:manual:end -->\n[a](other.md#one) [b](missing.md) [c](../../out.md) [d](https://x.y) [e](#top) `[f](no.md)`\n"


def test_markdown(spark):
    p = parse(PAGE)
    assert p["owner"] == "human" and p["page_anchors"] == ["a.ts#f", "b.ts#g"] and p["error"] is None
    assert [(s[0], s[2], s[4]) for s in p["section_anchors"]] == [("one", ["a.ts#f", "c.ts#h"], False), ("uber", ["d#d"], True)] or [(s[0], s[2], s[4]) for s in p["section_anchors"]] == [("one-", ["a.ts#f", "c.ts#h"], False), ("uber", ["d#d"], True)]
    assert [x[1] for x in p["links"]] == ["other.md#one", "missing.md", "../../out.md", "https://x.y", "#top"]
    assert all(PAGE[o:].startswith("#") for _, _, _, o in p["headings"]) and len(p["manual_blocks"]) == 1
    assert len(mask_code(PAGE)) == len(PAGE) and open_fence("```\nx") and not open_fence("~~~\n```\n~~~")
    assert front_matter("---\ntitle: x\n")[2] == "unclosed front matter" and front_matter("no head") == ({}, 0, None) and front_matter("---\n???\n---\n")[2]
    docs = spark.createDataFrame([("w/p.md", PAGE), ("w/other.md", "# One\n<think>x</think>"), ("w/bad.md", "---\ntitle: x\n"), ("w/n.md", None)], "wiki_path string, text string")
    pages = parse_pages(docs).persist()
    s = symbols(spark, [(1, 1, "a.ts#f", "f", "function", None, 1, 2, "h", "active"), (2, 1, "b.ts#g", "g", "function", None, 1, 2, "h", "deleted")])
    stored = spark.createDataFrame([("w/p.md",), ("w/gone.md",)], "wiki_path string")
    blocks = spark.createDataFrame([("w/p.md", "nope"), ("w/p.md", "nope")], "wiki_path string, content_hash string")
    issues = sorted(tuple(r) for r in verify.verify_pages(pages, s, stored, blocks).collect())
    assert issues == sorted(
        [("w/p.md", "broken_anchor", "b.ts#g"), ("w/p.md", "broken_anchor", "c.ts#h"), ("w/p.md", "broken_anchor", "d#d"), ("w/other.md", "think_block_present", ""), ("w/bad.md", "malformed_frontmatter", "unclosed front matter"), ("w/p.md", "broken_internal_link_page", "missing.md"), ("w/p.md", "broken_internal_link_outside", "../../out.md"), ("w/gone.md", "missing_wiki_path", ""), ("w/p.md", "manual_block_altered", "nope"), ("w/p.md", "manual_block_altered", "nope")]
    )


def test_status(spark):
    files = spark.createDataFrame([(1, "a.ts", "typescript", "active"), (2, "b.md", None, "active")], "id long, path string, lang string, status string")
    debt = spark.createDataFrame([("1", "a.ts#f", "changed", "agent", 5), ("2", "b.md#x", "moved", "human", 1), ("3", "gone.ts#y", "deleted", "agent", 1)], "id string, symbol_key string, event string, assignee string, detected_at int")
    e = spark.createDataFrame([("x.ts", "a.ts"), ("y.ts", "a.ts"), ("y.ts", "a.ts"), ("z.ts", "a.ts")], "from_file string, to_file string")
    churn = spark.createDataFrame([("a.ts", 4)], "path string, commits int")
    assert [(r["id"], r["score"]) for r in status.risk_ranked(debt, files, e, churn).collect()] == [("1", 70), ("2", 15), ("3", 10)]
    assert tuple(status.debt_counts(debt).first()) == (1, 1, 1, 2, 1, 3)
    assert {tuple(r) for r in status.debt_by_role(debt, files).collect()} == {("product", 2, "a.ts#f,b.md#x", 3)}
    b = spark.createDataFrame([("new", 10**10, 10**10), ("upd", 1, 10**10), ("old", 1, 2)], "wiki_path string, first_at long, last_at long")
    assert {tuple(r) for r in status.badges(b).collect()} == {("new", "new"), ("upd", "updated"), ("old", "none")}


def test_activity(spark):
    rows = [(1, "p", "payment", 5, 0, 1), (2, "p", "package", 10, 0, 1), (3, "p", "payment", 20, 0, 1), (4, "p", "package", 30, 2, 1), (5, "p", "payment", 25, 0, 1), (6, "p", "payment", 7230, 0, 1), (7, "q", "payment", 40, 0, 3)]
    df = spark.createDataFrame(rows, "seq long, page string, kind string, sec long, debt_count int, tokens long").withColumn("ts", F.timestamp_seconds("sec"))
    # one last package over the whole ledger, whatever the page; both kinds of payment, in blocks of any size
    more = df.unionByName(spark.createDataFrame([(8, "q", "resolved", 3630, 0, 0), (9, "q", "package", 9000, 1, 0), (10, "p", "resolved", 8999, 0, 0), (11, "z", "payment", 9000, 0, 0)], "seq long, page string, kind string, sec long, debt_count int, tokens long").withColumn("ts", F.timestamp_seconds("sec")))
    for unit in (1, 2, 4096):
        assert sorted(r["seq"] for r in activity.paired_payments(more, unit).collect()) == [6, 7, 8, 11]
    assert tuple(activity.hours_to_pay(activity.paired_payments(df)).first()) == (1.0, 2.0, 2)
    assert activity.paired_payments(df.limit(0)).collect() == []
    assert tuple(activity.activity_totals(df).first()) == (2, 5, 0, 9, 1.8)
    assert [r["running"] for r in activity.running_total(df, "seq", "tokens", unit=2).orderBy("seq").collect()] == [1, 2, 3, 4, 5, 6, 9]
    assert [tuple(r) for r in activity.top_pages(df).collect()] == [("p", 4, 6), ("q", 1, 3)]
    u = spark.createDataFrame([("s", 1, True, 1, 1, 2.0), ("s", 1, True, 1, 1, None), ("s", 2, True, 5, 5, 3.0), ("s", 3, False, 9, 9, 9.0)], "stage string, task int, known boolean, input_tokens long, output_tokens long, cost double")
    assert tuple(activity.token_account(u, ["stage"]).first()) == ("s", 7, 7, 3.0, True)
    a = spark.createDataFrame([(i, 1, f) for i, f in enumerate([True, False, True, True, True])], "n int, g int, failed boolean")
    assert [r["open"] for r in activity.breaker(a, "g", "n").orderBy("n").collect()] == [False, False, True, True, True]


def test_stored_search_indexes(spark, tmp_path):
    docs = spark.createDataFrame([("a", "the loadRecord function and a sealed channel"), ("b", "load the record"), ("c", "channel sealed"), ("d", None), ("e", "")], "wiki_path string, text string")
    search.store_indexes(docs, str(tmp_path))
    for q in ("record", "load*", "l*", '"sealed channel"', "channel NOT the", "nothing"):
        assert search.search(docs, q, folder=str(tmp_path)).orderBy("rank").collect() == search.search(docs, q).orderBy("rank").collect()
    index, sizes = search.load_index(spark, f"{tmp_path}/plain")
    plan = search.match(index, "record", sizes)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and sizes.first()["n_docs"] == 3


def test_file_plans_and_counters(spark):
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    files = spark.createDataFrame([
        (1, "same.ts", h("a\n"), "typescript", "active"), (2, "new.ts", h("old"), "typescript", "active"), (3, "gone.ts", h("x"), "typescript", "active"), (4, "back.ts", h("b"), "typescript", "deleted"), (5, "raw.ts", h("a\r\nb"), "typescript", "active"),
        (6, "flip.ts", h("c\r\nd"), "typescript", "active"), (7, "old.ts", h("q"), "typescript", "deleted"), (8, "silent.go", h("g"), "go", "active"), (9, "built.py", h("p"), "python", "active"), (10, "label.md", h("m"), "md", "active"), (11, "renamed.md", h("m"), "prose", "active"),
    ], "id long, path string, content_hash string, lang string, status string")
    found = spark.createDataFrame([("same.ts", "typescript", "a\r\n"), ("new.ts", "typescript", "new"), ("back.ts", "typescript", "b"), ("raw.ts", "typescript", "a\r\nb"), ("flip.ts", "typescript", "c\nd"), ("added.ts", "typescript", "n"), ("silent.go", "go", "g"), ("built.py", "python", "p"), ("label.md", "md", "m"), ("renamed.md", "md", "m")], "path string, lang string, content string")
    symbols = spark.createDataFrame([(i, "active") for i in (1, 2, 3, 9)] + [(8, "deleted"), (None, "active")], "file_id long, status string")
    g = lambda *rows: spark.createDataFrame(list(rows), "ext string, grammar string, artifact string")
    new = g(("ts", "ts", "1"), ("go", "go", "1"), ("py", "py", "2"))
    plan = lambda x: {r["path"]: r["action"] for r in ledger.file_plan(files, found, symbols, x).collect()}
    base = {"same.ts": "unchanged", "new.ts": "update", "gone.ts": "delete", "back.ts": "unchanged", "raw.ts": "migrate", "flip.ts": "migrate", "old.ts": "gone", "added.ts": "add", "silent.go": "unchanged", "built.py": "unchanged", "label.md": "unchanged", "renamed.md": "unchanged"}
    assert plan(None) == base
    assert plan(ledger.grammar_changes(g(("ts", "ts", "1"), ("py", "py", "1")), new)) == base | {"silent.go": "reprocess", "built.py": "reprocess", "renamed.md": "reprocess"}
    assert plan(ledger.grammar_changes(None, new)) == base | {"silent.go": "reprocess"}
    verdicts = spark.createDataFrame([(1, "binary"), (2, "too large"), (3, "kept")], "file_id long, verdict string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    got = ledger.index_counters(ledger.file_plan(files, found, symbols), verdicts, keys("a", "b", "b"), keys("b", "c", "d")).first().asDict()
    assert got == {"scanned": 10, "added": 1, "updated": 1, "deleted": 1, "reprocessed_grammar": 0, "unchanged": 8, "reactivated": 1, "skipped_binary": 1, "skipped_too_large": 1, "symbols_added": 2, "symbols_deleted": 1}
    assert ledger.file_plan(files.limit(0), found.limit(0), symbols.limit(0)).collect() == []


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace as N

    from codeloom.plans.lineage import shared_folder

    seen = []
    folder = lambda: N(isEmpty=lambda: not seen, get=lambda: seen[-1])
    session = lambda master, named: N(sparkContext=N(master=master, getConf=lambda: N(get=lambda k, d: named), _jsc=N(sc=lambda: N(getCheckpointDir=folder)), setCheckpointDir=seen.append), conf=N(get=lambda k, d: None))
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_folder(session(master, None))
    assert shared_folder(session("yarn", "hdfs:///shared")) == "hdfs:///shared" and seen == ["hdfs:///shared"]
    seen.clear()
    assert "codeloom-" in shared_folder(session("local[4]", None))


def test_search(spark):
    docs = spark.createDataFrame([("a", "the loadRecord function and a sealed channel"), ("b", "load the record"), ("c", "channel sealed"), ("d", None), ("e", "")], "wiki_path string, text string")
    index = search.inverted_index(docs, "wiki_path", "text")
    hit = lambda q: sorted(r["doc"] for r in search.match(index, q).collect())
    assert hit("channel") == ["a", "c"] and hit('"sealed channel"') == ["a"] and hit("load*") == ["a", "b"] and hit("the AND record") == ["b"] and hit("the record OR sealed") == ["a", "b", "c"]
    assert hit("channel NOT the") == ["c"]
    assert hit("(channel OR load) NOT sealed") == ["b"] and hit("record OR (channel AND (sealed NOT the))") == ["b", "c"] and hit("(sealed channel)") == ["a", "c"]
    for bad in ("", "AND", "a OR", '"', "(a", "*", "a)", "NOT a", "()", "a NOT"):
        assert hit(bad) == []
    got = [(r["rank"], r["doc"], r["source"]) for r in search.search(docs, "record").orderBy("rank").collect()]
    assert got == [(1, "b", "plain"), (2, "a", "split")]
    changed = search.inverted_index(spark.createDataFrame([("c", "fresh words")], "wiki_path string, text string"), "wiki_path", "text")
    now = search.upsert(index, changed, spark.createDataFrame([("b",)], "doc string"))
    assert {r["doc"] for r in now.select("doc").distinct().collect()} == {"a", "c"} and now.where("term = 'sealed' and doc = 'c'").isEmpty()


def test_planning(spark):
    m = spark.createDataFrame([("m", "a", "test"), ("m", "b", "product"), ("n", "c", "test"), ("n", "d", "test"), ("n", "e", "product")], "module string, path string, role string")
    assert {tuple(r) for r in planning.module_roles(m).collect()} == {("m", "product", 1), ("n", "test", 2)}
    e = spark.createDataFrame([("m", "n"), ("o", "n"), ("n", "m")], "from_module string, to_module string")
    p = planning.module_priority(spark.createDataFrame([("m", "product", 5), ("n", "test", 9), ("o", "product", 7)], "module string, role string, n_symbols int"), e)
    assert [(r["module"], r["priority"]) for r in p.collect()] == [("m", 1005), ("o", 7), ("n", 2009)]
    assert {tuple(r) for r in planning.related_modules(e, p, 1).collect()} == {("m", "n", True, True, 1), ("n", "m", True, True, 1), ("o", "n", True, False, 1)}


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def f():\n    return g(1)\n\nclass C:\n    def m(self):\n        f()\n")
    (tmp_path / "src/b.ts").write_text("export function h(x) {\n  return k(x);\n}\n// TODO: explain why this is so slow\n")
    (tmp_path / "bin.py").write_bytes(b"a\x00b")
    (tmp_path / "noext").write_text("x")
    (tmp_path / "big.py").write_text("#" * (2 << 20))
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("x")
    (tmp_path / "made").mkdir()
    (tmp_path / "made/y.js").write_text("y")
    (tmp_path / "src/z.gen.ts").write_text("z")
    (tmp_path / ".gitignore").write_text("# ours\nmade/\n\n*.gen.ts\n!src/a.py\n")
    walked = scan.walk(spark, str(tmp_path))
    assert sorted((r["path"], r["lang"]) for r in walked.collect()) == [("src/a.py", "python"), ("src/b.ts", "typescript")]
    parsed = {r["path"]: r for r in scan.parse_files(walked).collect()}
    assert [s["key"] for s in parsed["src/a.py"]["symbols"]] == ["src/a.py#f", "src/a.py#C", "src/a.py#C.m"]
    assert {(c["caller_key"], c["callee_name"]) for c in parsed["src/a.py"]["calls"]} == {("src/a.py#f", "g"), ("src/a.py#C.m", "f")}
    assert [tuple(s)[:5] for s in parsed["src/b.ts"]["symbols"]] == [("src/b.ts#h", "h", "function", 1, 3)]
    r = scan.rationales(walked.select(F.col("path").alias("file_id"), "content")).collect()
    assert [(x["kind"], x["line"], x["text"]) for x in r] == [("todo", 4, "explain why this is so slow")]


def test_concerns_and_anchors(spark):
    m = spark.createDataFrame([("m", "a/Dockerfile"), ("m", "a/x.test.ts"), ("n", "b/y.ts"), ("m", "a/scripts/z.sh")], "module string, path string")
    assert {tuple(r) for r in planning.concern_groups(m).collect()} == {("Deployment", "m", "a/Dockerfile", 2), ("Testing", "m", "a/x.test.ts", 1)}
    rows = [("c", "g1", "a", 10, True, 5), ("c", "g1", "b", 10, True, 4), ("c", "g2", "x", 10, False, 9), ("c", "g2", "d", 10, True, 1), ("c", "g3", "e", 99, True, 1), ("k", "g", "z", 10, False, 1)]
    got = planning.choose_anchors(spark.createDataFrame(rows, "cluster string, group string, id string, chars int, is_product boolean, weight int"), 3, 40)
    assert sorted(tuple(r) for r in got.collect()) == [("c", 1, "a"), ("c", 2, "d"), ("c", 3, "b")]
    # one that fits comes after thousands that don't
    many = spark.range(5000).selectExpr("'big' as cluster", "'g' as group", "format_string('%05d', id) as id", "cast(if(id = 4999, 3, 50) as int) as chars", "true as is_product", "cast(1 as int) as weight")
    assert [tuple(r) for r in planning.choose_anchors(many, 3, 53).orderBy("position").collect()] == [("big", 1, "04999"), ("big", 2, "00000")]
    assert column(spark, ["The config of a server", "nothing"], lambda c: F.array_join(X.topic_signals(c), "+")) == ["configuration+entry/boundary", ""]


def test_page_overlaps_of_hot_items(spark, tmp_path):
    rng = random.Random(5)
    sets = {f"p{i:02d}": {f"a/d{rng.randrange(6)}/f.py#x" for _ in range(3)} | {"a/hot/f.py#x"} for i in range(40)}
    # half of the keys stand in sections, and pages with equal sets make one class
    section = "array<struct<symbol_keys:array<string>>>"
    rows = [(k, sorted(v)[::2], [(sorted(v)[1::2],), (None,)]) for k, v in sets.items()]
    spark.createDataFrame(rows, f"wiki_path string, page_anchors array<string>, section_anchors {section}").write.parquet(str(tmp_path / "extracted_anchors.parquet"))
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= min(len(sets[a]), len(sets[b]))}
    pairs = [tuple(r) for r in workspace_queries.page_overlaps(spark, str(tmp_path)).collect()]
    links = {r["id"]: (r["cls"], r["n_links"]) for r in workspace_queries.page_overlap_links(spark, str(tmp_path)).collect()}
    members = {}
    for k, (c, _) in links.items():
        members.setdefault(c, []).append(k)
    across = {(min(x, y), max(x, y), n) for a, b, n in pairs for x in members[a] for y in members[b]}
    alike = {(x, y, len(sets[x])) for m in members.values() for x in m for y in m if x < y}
    assert len(pairs) == len(set(pairs)) < len(want) and across | alike == want and len(want) > 300
    assert {k: n for k, (_, n) in links.items()} == {k: sum(k in w[:2] for w in want) for k in sets}


def written(spark, job):
    """What job gives, and the rows that its stages wrote to shuffles."""
    context = spark.sparkContext
    scala = context._jsc.sc()

    def stages():
        scala.listenerBus().waitUntilEmpty()
        found = scala.statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = job()
    return out, sum(n for k, n in stages().items() if k not in before)


def hot_sets():
    """Sets of three that all have one item and few of which share another, so that the hot item alone makes no pair; some of two that it pairs."""
    rng = random.Random(7)
    return {f"p{i:04d}": {"hot", f"d{rng.randrange(3000)}"} | ({f"e{i}"} if i % 300 else set()) for i in range(1100)}


def overlaps(sets, least=0.5):
    pairs = ((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b)
    return {(a, b, n) for a, b, n in pairs if n and n >= least * min(len(sets[a]), len(sets[b]))}


def test_links_by_a_hot_item_are_counted_where_they_are_met(spark):
    sets = hot_sets()
    df = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "id string, item string")
    links, n = written(spark, lambda: {r["id"]: r["n_links"] for r in resolve.overlap_links(df).collect()})
    want = dict.fromkeys(sets, 0)
    for a, b, _ in overlaps(sets):
        want[a] += 1
        want[b] += 1
    assert links == want and len(set(want.values())) > 2 and n < 100_000  # 605,000 pairs have the hot item


def test_pairs_by_a_hot_item_are_counted_where_they_are_met(spark):
    sets = hot_sets()
    df = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "id string, item string")
    pairs, n = written(spark, lambda: [tuple(r) for r in resolve.overlap_pairs(df).select("a", "b", "shared").collect()])
    members = {frozenset(v): k for k, v in sorted(sets.items(), reverse=True)}
    want = overlaps({k: set(v) for v, k in members.items()})
    assert len(pairs) == len(want) > 1000 and set(pairs) == want and n < 100_000


@pytest.mark.parametrize("least,wide", [(0.5, 64), (0.5, 4), (0.5, 0), (0.3, 5), (2 / 3, 5), (1.0, 64), (0.0, 5)])
def test_class_pairs_of_any_size(spark, least, wide):
    rng = random.Random(3)
    sets = {f"s{i:02d}": {f"i{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.choice((1, 2, 3, 5, 8, 30)))} for i in range(60)}
    rows = [(k, x) for k, v in sets.items() for x in v]
    df = resolve.distinct_sets(spark.createDataFrame([*rows, *rows[:9], (None, "i1"), ("s01", None)], "id string, item string"))
    members = resolve.overlap_classes(df)
    cls = {r["id"]: r["cls"] for r in members.collect()}
    size = {c: sum(x == c for x in cls.values()) for c in cls.values()}
    got = [tuple(r) for r in resolve.class_pairs(df, members, least, wide).collect()]
    want = {(a, b, n, n / min(len(sets[a]), len(sets[b])), size[a], size[b]) for a, b, n in overlaps({c: sets[c] for c in size}, least)}
    assert len(got) == len(want) and set(got) == want


def test_blocked_join(spark):
    small = spark.createDataFrame([("hot", f"a{i}") for i in range(9)] + [("cold", "a1"), ("none", "a2")], "g string, a string")
    large = spark.createDataFrame([("hot", f"b{i}", i) for i in range(30)] + [("cold", "b1", 1), ("other", "b2", 2)], "g string, b string, n int")
    got = [tuple(r) for r in resolve.blocked_join(small, large, "g", 4).select("g", "a", "b", "n").collect()]
    assert sorted(got) == sorted([("hot", f"a{i}", f"b{j}", j) for i in range(9) for j in range(30)] + [("cold", "a1", "b1", 1)])


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(400)] + [("x", "y"), ("z", "z"), (None, "a")], "src string, dst string")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert set(got.values()) == {"n0000", "x"} and len(got) == 403


def test_blast_radius_ends_as_soon_as_it_is_full(spark):
    e = spark.createDataFrame([("b", "a", False), ("c", "a", True), ("d", "b", True), ("d", "c", False), ("a", "d", True)], "caller string, callee string, extracted boolean")
    rows = lambda **k: [tuple(r) for r in graph.blast_radius(e, "a", **k).orderBy("depth", "caller").collect()]
    assert rows() == [("b", 1, False, True, False), ("c", 1, True, True, False), ("d", 2, True, False, False)]
    assert rows(max_nodes=3) == [(*r[:4], True) for r in rows()] and rows(max_nodes=2) == [(*r[:4], True) for r in rows()[:2]] and rows(max_depth=1) == rows(max_nodes=2)
    assert rows(max_depth=2) == [(*r[:4], True) for r in rows()] and graph.blast_radius(e, "none").collect() == []


def test_blocked_pairs(spark):
    rows = [(f"n{i:02d}", "hot") for i in range(30)] + [("n01", "cold"), ("n02", "cold"), ("n99", "cold")]
    got = [tuple(r) for r in resolve.blocked_pairs(spark.createDataFrame(rows, "id string, g string"), "g", 4).collect()]
    want = [(f"n{i:02d}", f"n{j:02d}") for i in range(30) for j in range(i + 1, 30)] + [("n01", "n02"), ("n01", "n99"), ("n02", "n99")]
    assert sorted(got) == sorted(want)


def test_communities_of_large_components(spark):
    rng = random.Random(11)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(110)] + [(f"b{i}", f"c{j}") for i in range(4) for j in range(5)]
    in_one_task = {r["node"]: r["community"] for r in graph.communities(edges(spark, pairs)).collect()}
    by_joins = graph.communities(edges(spark, pairs), largest=0).collect()
    assert {r["node"]: r["community"] for r in by_joins} == in_one_task and not any(r["sequential"] for r in by_joins)
    once = {r["node"]: r["community"] for r in graph.communities(edges(spark, pairs), passes=1).collect()}
    assert {r["node"]: r["community"] for r in graph.communities(edges(spark, pairs), passes=1, largest=0).collect()} == once != in_one_task


def test_module_components_over_all_edges(spark, monkeypatch):
    calls = [("a/a/x", "b/b/x")] * 2 + [("b/b/x", "a/a/x")] * 2 + [("a/a/x", "c/c/x"), ("c/c/x", "d/d/x"), ("e/e/x", "f/f/x")]
    paths = sorted({p for c in calls for p in c})
    files = [(p.replace("/x", f"/{i}"), p[:3]) for p in paths for i in range(2)]
    rows = [(a.replace("/x", f"/{i}"), b.replace("/x", f"/{i}")) for a, b in calls[:4:2] for i in range(2)] + [(a.replace("/x", "/0"), b.replace("/x", "/0")) for a, b in calls[4:]]
    monkeypatch.setattr(workspace_queries, "_edges", lambda s, d: spark.createDataFrame(rows, "from_file string, to_file string"))
    monkeypatch.setattr(workspace_queries, "_members", lambda s, d: spark.createDataFrame(files, "path string, module string"))
    got = {r["node"]: r["component"] for r in workspace_queries.module_components(spark, "").collect()}
    assert got == {"a/a": "a/a", "b/b": "a/a", "c/c": "a/a", "d/d": "a/a", "e/e": "e/e", "f/f": "e/e"}

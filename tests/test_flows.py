"""Walks, their ranking and the choice without near-duplicates, against going through them one by one."""

import random

import pytest

from codeloom.operators import flows


def search(adjacency, root, longest, budget):
    """Depth-first with sorted neighbours and a budget of visits, as a person would write it."""
    seen = []

    def visit(path):
        seen.append(tuple(path))
        if len(path) < longest:
            for n in sorted(adjacency.get(path[-1], ())):
                if len(seen) >= budget:
                    return
                if n not in path:
                    visit([*path, n])

    visit([root])
    return seen


@pytest.mark.parametrize("seed,nodes,degree,longest,budget", [(1, 12, 4, 8, 64), (2, 30, 9, 5, 20), (3, 8, 7, 8, 64), (4, 90, 80, 4, 64), (5, 6, 2, 3, 2)])
def test_walks_are_those_of_a_search_with_a_budget(spark, seed, nodes, degree, longest, budget):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(nodes)]
    pairs = [(a, b) for a in names for b in rng.sample(names, degree)]
    adjacency = {a: {b for x, b in pairs if x == a and b != a} for a in names}
    e = spark.createDataFrame([*pairs, *pairs[:5]], "src string, dst string")
    got = {}
    for r in flows.walks(e, spark.createDataFrame([(n,) for n in names[:6]], "node string"), longest, budget).collect():
        got.setdefault(r["root"], []).append(tuple(r["path"]))
    assert {k: sorted(v) for k, v in got.items()} == {n: sorted(search(adjacency, n, longest, budget)) for n in names[:6]}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_choice(spark, seed):
    rng = random.Random(seed)
    rows = [(i // 2, f"c{i}", rng.sample("abcdefghij", rng.randrange(0, 6))) for i in range(60)]
    accepted = []
    for _, c, items in sorted(rows):
        if all(len(set(items) & set(x)) <= 0.6 * min(len(items), len(x)) for _, x in accepted):
            accepted.append((c, items))
    got = flows.greedy_apart(spark.createDataFrame(rows, "rank long, id string, items array<string>"), 0.6).collect()
    assert sorted(r["id"] for r in got) == sorted(c for c, _ in accepted)


def test_ranked_flows(spark):
    members = [("cli", "src/cli.ts"), ("core", "src/core/a.ts"), ("db", "src/database/b.ts"), ("net", "src/net.ts"), ("t", "t/x.test.ts"), ("lone", "src/lone.ts")]
    m = spark.createDataFrame([*members, (None, "x"), ("core", None)], "module string, path string")
    e = spark.createDataFrame([("cli", "core"), ("core", "db"), ("core", "net"), ("t", "core"), ("core", "core"), ("core", "cli"), ("lone", "cli")], "src string, dst string")
    x = spark.createDataFrame([("src/net.ts", "axios"), ("src/core/a.ts", "./near"), ("src/core/a.ts", "node:fs"), ("src/core/a.ts", "")], "path string, specifier string")
    signals = {r["module"]: tuple(r)[1:] for r in flows.module_signals(m, e, x).collect()}
    assert signals == {"cli": (True, False, False, True, False), "core": (False, False, False, True, False), "db": (False, True, False, True, False), "net": (False, False, True, True, False), "t": (True, False, False, False, True), "lone": (True, False, False, True, False)}
    s = flows.module_signals(m, e, x)
    q = flows.qualified_walks(e, s)
    assert {tuple(r["path"]) for r in q.collect()} == {("cli", "core", "db"), ("cli", "core", "net"), ("lone", "cli", "core", "db"), ("lone", "cli", "core", "net")}
    got = [(r["rank"], r["slug"], r["n_product"], r["centrality"]) for r in flows.rank_flows(q, s).orderBy("rank").collect()]
    assert got == [(1, "lone-to-db", 4, 4), (2, "lone-to-net", 4, 4), (3, "cli-to-db", 3, 4), (4, "cli-to-net", 3, 4)]
    assert flows.rank_flows(q.limit(0), s).collect() == [] and flows.qualified_walks(e.limit(0), s.limit(0)).collect() == []

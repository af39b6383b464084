"""Graph operators over edge tables: reach, components, communities, paths, trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import path_prefixes
from codeloom.plans.lineage import cut


def blast_radius(edges: DataFrame, start: str, max_depth: int = 5, max_nodes: int = 200) -> DataFrame:
    """Callers that reach `start`, by breadth-first search against the calls: caller, depth, extracted, direct, truncated.

    edges: caller, callee, extracted. Each level is one join of the edges with the last level's nodes, which are at most
    max_nodes; extracted is that of the edge by which a node was first found, in order of (depth, order of the callee, caller).
    truncated holds for all rows: the search came to max_nodes, or found nodes at max_depth. start itself is no row.
    """
    spark = edges.sparkSession
    seen, rows, frontier, truncated = {start}, [], [start], False
    for depth in range(1, max_depth + 1):
        ranked = spark.createDataFrame([(k, i) for i, k in enumerate(frontier)], "callee string, rank int")
        near = edges.join(F.broadcast(ranked), "callee").where(F.col("caller") != start)  # at most max_nodes rows are broadcast
        first = near.groupBy("caller").agg(F.min(F.struct("rank", (~F.col("extracted")).alias("inferred"))).alias("m"))
        room = max_nodes - len(rows)
        # nodes seen before are at most max_nodes, so this many more are enough to find the new ones
        got = first.orderBy("m.rank", "caller").limit(room + len(seen) + 1).collect()
        new = [(r["caller"], not r["m"]["inferred"]) for r in got if r["caller"] not in seen]
        frontier = []
        for caller, extracted in new:
            seen.add(caller)
            rows.append((caller, depth, extracted, depth == 1))
            frontier.append(caller)
            if len(rows) >= max_nodes:
                truncated = True
                break
        if truncated or not frontier:
            break
    else:
        truncated = True
    return spark.createDataFrame([(*r, truncated) for r in rows], "caller string, depth int, extracted boolean, direct boolean, truncated boolean")


def reach(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """node, depth: everything that leads to the roots within max_depth steps, without a cap on nodes. edges: src, dst; roots: node."""
    known = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    last = known
    for depth in range(1, max_depth + 1):
        step = edges.join(last.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        last = cut(step.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            break
        known = cut(known.unionByName(last))
    return known


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component: connected components of an undirected graph, named by their smallest node.

    edges: src, dst. Each round every node takes the least label among itself and its neighbours, and then the label of that
    label, which halves distances; the rounds needed grow with the logarithm of a chain's length, and go on until no label moves. Labels are
    written to the shared folder each round. nodes: node, to have those without edges too.
    """
    both = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    both = cut(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    all_nodes = both.select(F.col("src").alias("node"))
    if nodes is not None:
        all_nodes = all_nodes.unionByName(nodes.select("node").where("node is not null"))
    labels = cut(all_nodes.distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old"))
        hop = moved.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = cut(moved.join(hop, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "old"))
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels


def _propagate(nodes: list[str], near: dict[str, list[str]], passes: int) -> dict[str, str]:
    label = {n: n for n in nodes}
    for _ in range(passes):
        changed = False
        for n in nodes:
            counts: dict[str, int] = {}
            for m in near.get(n, ()):
                counts[label[m]] = counts.get(label[m], 0) + 1
            if counts:
                top = max(counts.values())
                best = min(x for x, c in counts.items() if c == top)
                changed |= best != label[n]
                label[n] = best
        if not changed:
            break
    return label


def communities(edges: DataFrame, nodes: DataFrame | None = None, passes: int = 10, largest: int = 20_000) -> DataFrame:
    """node, community, sequential: label propagation in sorted order with labels changed in place, ties to the smallest label.

    Labels never leave a connected component, so the sequential pass runs once per component, in one task each. A component of
    more than `largest` nodes doesn't go into one task: its passes are made by joins, with the same labels; sequential is then
    false. In a pass a node sees the new labels of smaller neighbours and the old ones of greater neighbours; all nodes are
    voted on again until no new label moves, which is where the sequential pass ends, as the smallest node that isn't settled
    depends on settled ones only.
    """
    parts = components(edges, nodes)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = cut(parts.join(sizes, "component"))
    both = edges.where("src <> dst").select("src", "dst")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = both.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("near"))
    small = sized.where(F.col("size") <= largest).join(near, "node", "left").select("component", "node", "near")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["node"])
        label = _propagate(names, {n: list(x) if x is not None else [] for n, x in zip(pdf["node"], pdf["near"])}, passes)
        return pd.DataFrame({"node": names, "community": [label[n] for n in names], "sequential": True})

    out = small.groupBy("component").applyInPandas(run, "node string, community string, sequential boolean")
    big = sized.where(F.col("size") > largest).select("node")
    if big.isEmpty():
        return out
    big_edges = cut(both.join(big.select(F.col("node").alias("src")), "src", "left_semi"))
    # old: the labels before the pass, new: those of the pass so far
    state = cut(big.select("node", F.col("node").alias("old"), F.col("node").alias("new")))
    for _ in range(passes):
        while True:
            seen = big_edges.join(state.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), F.when(F.col("dst") < F.col("src"), F.col("new")).otherwise(F.col("old")).alias("vote"))
            votes = seen.groupBy("node", "vote").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "vote")).alias("m"))
            voted = cut(state.join(votes, "node").select("node", "old", F.col("m.vote").alias("new"), F.col("new").alias("was")))
            state = voted.select("node", "old", "new")
            if voted.where("new <> was").isEmpty():
                break
        if state.where("new <> old").isEmpty():
            break
        state = state.select("node", F.col("new").alias("old"), "new")
    return out.unionByName(state.select("node", F.col("new").alias("community"), F.lit(False).alias("sequential")))


def partition_agreement(members: DataFrame, found: DataFrame) -> DataFrame:
    """Per module: dominant_community and its share of the module's files, and how many of its files sit in a community whose
    files mostly belong to another module. members: module, path (a path in several modules counts for the first); found: node,
    community. A module none of whose files has a community has the share -1 / files."""
    own = members.groupBy("path").agg(F.min("module").alias("module"))
    at = own.join(found.select(F.col("node").alias("path"), "community"), "path")
    by_community = at.groupBy("community", "module").agg(F.count(F.lit(1)).alias("n"))
    plural = by_community.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "module")).alias("m")).select("community", F.col("m.module").alias("plurality"))
    lost = at.join(plural, "community").groupBy("module").agg(F.sum(F.when(F.col("module") != F.col("plurality"), 1).otherwise(0)).alias("disagreements"))
    every = members.select("module", "path").distinct().join(found.select(F.col("node").alias("path"), "community"), "path")
    top = every.groupBy("module", "community").agg(F.count(F.lit(1)).alias("n")).groupBy("module").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("m"))
    sizes = members.groupBy("module").agg(F.count_distinct("path").alias("n_files"))
    out = sizes.join(top, "module", "left").join(lost, "module", "left")
    return out.select("module", F.col("m.community").alias("dominant_community"), (F.coalesce(-F.col("m.n"), F.lit(-1)) / F.col("n_files")).alias("dominant_share"), F.coalesce("disagreements", F.lit(0)).alias("disagreements"))


def strongest_edges(edges: DataFrame, fan_out: int = 2) -> DataFrame:
    """Of each source the fan_out edges of the greatest weight, ties to the smaller target. edges: src, dst, weight."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= fan_out).select("src", "dst")


def simple_paths(edges: DataFrame, roots: DataFrame, max_nodes: int = 5) -> DataFrame:
    """path: every path without a repeated node from a root, of two to max_nodes nodes, as an array. edges: src, dst; roots: node.

    Paths grow by one join per step; how many there are depends on the fan-out of the edges, see strongest_edges.
    """
    level = roots.select(F.array("node").alias("path")).distinct()
    out = None
    for _ in range(max_nodes - 1):
        grown = level.withColumn("src", F.element_at("path", -1)).join(edges.select("src", "dst").distinct(), "src").where(~F.array_contains("path", F.col("dst")))
        level = grown.select(F.concat("path", F.array("dst")).alias("path"))
        out = level if out is None else out.unionByName(level)
    return out


def maximal_paths(paths: DataFrame) -> DataFrame:
    """Paths that are not the beginning of another one."""
    keyed = paths.select("path", F.array_join("path", "\n").alias("k"))
    starts = keyed.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.array_join(F.slice("path", F.lit(1), n), "\n"))).alias("k")).distinct()
    return keyed.join(starts, "k", "left_anti").select("path")


def best_paths(paths: DataFrame) -> DataFrame:
    """Of each pair of ends the longest path, ties to the smallest."""
    ends = paths.select("path", F.element_at("path", 1).alias("entry"), F.element_at("path", -1).alias("sink"))
    best = ends.groupBy("entry", "sink").agg(F.min(F.struct((-F.size("path")).alias("n"), "path")).alias("m"))
    return best.select("entry", "sink", F.col("m.path").alias("path"))


def path_centrality(paths: DataFrame) -> DataFrame:
    """How many paths go through each node."""
    return paths.select(F.explode(F.array_distinct("path")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_paths"))


def joined_by_hub(members: DataFrame) -> DataFrame:
    """node, component: nodes that share a hub, directly or over others. members: node, hub. Each hub is one star, so no pairs are made."""
    star = members.groupBy("hub").agg(F.min("node").alias("dst"))
    edges = members.join(star, "hub").select(F.col("node").alias("src"), "dst").distinct()
    return components(edges, members.select("node").distinct())


def directory_tree(paths: DataFrame) -> DataFrame:
    """parent, child, n_files: the edges of the directory tree above the files, and the files below each child. paths: path."""
    dirs = paths.select(F.explode(path_prefixes(F.col("path"))).alias("child"), "path")
    parent = F.when(F.instr("child", "/") > 0, F.regexp_replace("child", "/[^/]*$", "")).otherwise("")
    return dirs.groupBy("child").agg(F.count(F.lit(1)).alias("n_files")).select(parent.alias("parent"), "child", "n_files")


def unique_suffixes(paths: DataFrame, levels: int = 8) -> DataFrame:
    """path, id: the shortest run of last segments that no other path has; a path that shares them all gets its hash at the end."""
    parts = F.split("path", "/")
    p = paths.select("path").distinct()
    tries = p.select("path", F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(levels)))).alias("n"), parts.alias("parts"))
    tries = tries.select("path", "n", F.array_join(F.slice("parts", -F.col("n"), F.col("n")), "/").alias("id"))
    alone = tries.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min("path").alias("path"), F.min("n").alias("n")).where("c = 1")
    best = alone.groupBy("path").agg(F.min(F.struct("n", "id")).alias("m")).select("path", F.col("m.id").alias("id"))
    return p.join(best, "path", "left").select("path", F.coalesce("id", F.concat_ws("-", F.element_at(parts, -1), F.substring(F.sha2("path", 256), 1, 8))).alias("id"))


def in_degree(edges: DataFrame) -> DataFrame:
    """dst, n: distinct sources of each target. edges: src, dst."""
    return edges.groupBy("dst").agg(F.count_distinct("src").alias("n"))

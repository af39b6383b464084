"""Flows: walks over the module graph from entries to modules that store or call outside, ranked, without near-duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import ENTRY_PATTERNS, STORE_PATTERNS, external_specifier, matches_any, narrow_test, path_role
from codeloom.functions.text import module_slug
from codeloom.operators.graph import best_paths, maximal_paths
from codeloom.operators.resolve import blocked_pairs
from codeloom.plans.lineage import cut


def module_signals(members: DataFrame, edges: DataFrame, externals: DataFrame | None = None, entry: list[str] = ENTRY_PATTERNS, store: list[str] = STORE_PATTERNS) -> DataFrame:
    """module, entry, persistence, external, product, only_tests of each module.

    members: module, path; edges: src, dst between modules; externals: path, specifier of imports that lead to no file of the
    workspace. A module is an entry if no other one leads to it or one of its files has an entry's name; product if most of its
    files are (ties go to product). Self edges and edges of unknown modules don't count.
    """
    own = members.select("module", "path").where("module is not null and path is not null").distinct()
    path = F.col("path")
    role = path_role(path)
    outside = own.select("path").limit(0) if externals is None else externals.where(external_specifier(F.col("specifier"))).select("path").distinct()
    marked = own.join(outside.withColumn("outside", F.lit(True)), "path", "left")
    per = marked.groupBy("module").agg(
        F.max(matches_any(path, entry)).alias("named"),
        F.max(matches_any(path, store)).alias("persistence"),
        F.coalesce(F.max("outside"), F.lit(False)).alias("external"),
        (F.count_if(role == "product") * 2 >= F.count(F.lit(1))).alias("product"),
        F.min(narrow_test(path)).alias("only_tests"),
    )
    led = edges.where("src <> dst").select(F.col("dst").alias("module")).distinct().withColumn("led", F.lit(True))
    return per.join(led, "module", "left").select("module", (F.col("led").isNull() | F.col("named")).alias("entry"), "persistence", "external", "product", "only_tests")


def walks(edges: DataFrame, roots: DataFrame, longest: int = 8, budget: int = 64) -> DataFrame:
    """root, path: of each root the first `budget` walks without a repeated node, of at most `longest` nodes, in the order of a depth-first
    search with sorted neighbours; the root alone is the first. edges: src, dst; roots: node.

    That order is the order of the paths as lists, so no search is run: paths grow by one join per length, and of each root only
    the first `budget` so far are kept, as longer ones can only come in between. At most `budget` rows a root, whatever the graph.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    first = roots.select(F.col("node").alias("root"), F.array("node").alias("path")).where("root is not null").distinct()
    kept = cut(first)
    w = Window.partitionBy("root").orderBy("path")
    # of a node's neighbours as many as the budget and the nodes of a path allow can matter
    near = Window.partitionBy("src").orderBy("dst")
    e = cut(e.withColumn("rn", F.row_number().over(near)).where(F.col("rn") <= budget + longest).select("src", "dst"))
    for length in range(1, longest):
        grown = kept.where(F.size("path") == length).withColumn("src", F.element_at("path", -1)).join(e, "src").where(~F.array_contains("path", F.col("dst")))
        more = kept.unionByName(grown.select("root", F.concat("path", F.array("dst")).alias("path")))
        kept = cut(more.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= budget).drop("rn"))
    return kept


def qualified_walks(edges: DataFrame, signals: DataFrame, longest: int = 8, budget: int = 64) -> DataFrame:
    """path: the walks of two nodes or more from entries that aren't all tests, through a module that stores or calls outside, once each."""
    roots = signals.where("entry and not only_tests").select(F.col("module").alias("node"))
    known = signals.select("module")
    e = edges.join(known.withColumnRenamed("module", "src"), "src", "left_semi").join(known.withColumnRenamed("module", "dst"), "dst", "left_semi")
    found = walks(e, roots, longest, budget).where(F.size("path") > 1).select("path").distinct()
    over = signals.where("persistence or external").select(F.col("module").alias("node"))
    crossing = found.select("path", F.explode("path").alias("node")).join(over, "node", "left_semi").select("path").distinct()
    return crossing


def rank_flows(qualified: DataFrame, signals: DataFrame) -> DataFrame:
    """rank, slug, path, n_product, centrality: of each pair of ends the longest walk that begins no other one, most product modules first, then
    most central, then by slug. centrality: how many qualified walks share a module with it. Equal slugs get -2, -3 in order of path."""
    best = best_paths(maximal_paths(qualified)).select("path")
    base = module_slug(F.concat(F.element_at("path", 1), F.lit("-to-"), F.element_at("path", -1)))
    named = best.withColumn("base", F.when(base != "", base).otherwise("flow"))
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("path")))
    slugged = named.select("path", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n")).alias("slug"))
    on = qualified.select(F.array_join("path", "\n").alias("walk"), F.explode(F.array_distinct("path")).alias("node"))
    mine = slugged.select("slug", F.explode(F.array_distinct("path")).alias("node"))
    central = mine.join(on, "node").select("slug", "walk").distinct().groupBy("slug").agg(F.count(F.lit(1)).alias("centrality"))
    product = mine.join(signals.where("product").select(F.col("module").alias("node")), "node", "left_semi").groupBy("slug").agg(F.count(F.lit(1)).alias("n_product"))
    scored = slugged.join(central, "slug").join(product, "slug", "left").withColumn("n_product", F.coalesce("n_product", F.lit(0)))
    return ranked(scored, [F.desc("n_product"), F.desc("centrality"), F.asc("slug")])


def ranked(df: DataFrame, order: list) -> DataFrame:
    """df with rank by an order. Rows are sorted in parallel and numbered by partition, so they don't meet in one task."""
    ordered = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    return ordered.join(before, "__part").select((F.col("before") + F.col("__at") - F.col("first") + 1).alias("rank"), *df.columns)


def greedy_apart(candidates: DataFrame, most_overlap: float = 0.75) -> DataFrame:
    """rank, id of the candidates accepted in rank order, each overlapping every one accepted before by at most most_overlap of the smaller set.

    candidates: rank, id, items (array). Candidates that overlap by more are paired by their shared items, in blocks; then, round by round, whoever is
    first among its undecided neighbours is accepted and its neighbours are dropped, which is what going through them one by one gives.
    A null id or an empty set overlaps nothing.
    """
    ids = cut(candidates.select("rank", "id", F.array_distinct(F.coalesce("items", F.array().cast("array<string>"))).alias("items")))
    sizes = ids.select("id", "rank", F.size("items").alias("n"))
    shared = blocked_pairs(ids.where("id is not null").select("id", F.explode("items").alias("item")).distinct(), "item").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    near = shared.join(sizes.select(F.col("id").alias("a"), F.col("rank").alias("ra"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("rank").alias("rb"), F.col("n").alias("nb")), "b")
    near = near.where(F.col("shared") > most_overlap * F.least("na", "nb"))
    before = F.struct("ra", "a") < F.struct(F.col("rb").alias("ra"), F.col("b").alias("a"))
    arcs = cut(near.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("second")))
    undecided = ids.select("rank", "id")
    lost: list[DataFrame] = []
    while not arcs.isEmpty():
        # those with an arc and none before them are taken; what they lead to is dropped
        taken = cut(arcs.select(F.col("first").alias("id")).distinct().join(arcs.select(F.col("second").alias("id")), "id", "left_anti"))
        dropped = cut(arcs.join(taken.withColumnRenamed("id", "first"), "first", "left_semi").select(F.col("second").alias("id")).distinct())
        lost.append(dropped)
        gone = taken.unionByName(dropped)
        arcs = cut(arcs.join(gone.withColumnRenamed("id", "first"), "first", "left_anti").join(gone.withColumnRenamed("id", "second"), "second", "left_anti"))
    if not lost:
        return undecided
    return undecided.join(reduce(DataFrame.unionByName, lost), "id", "left_anti").select("rank", "id")

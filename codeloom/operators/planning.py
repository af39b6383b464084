"""Planning over modules: roles, sizes, priority, relations, coverage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import dir_name, matches_any, path_role

#: which role wins a tie within a module (fixed values)
ROLE_ORDER = {"product": 0, "docs": 1, "tooling": 2, "fixture": 3, "test": 4}

#: paths that show that a module has to do with deployment (fixed values)
DEPLOYMENT_PATTERNS = ["**/Dockerfile*", "**/docker-compose*", "**/*.bat", "**/*.ps1", "**/scripts/**", "**/deploy/**"]


def module_roles(members: DataFrame) -> DataFrame:
    """module, role, n: the most frequent role of a module's files, ties by fixed order. members: module, path, role."""
    rank = F.create_map(*[F.lit(x) for kv in ROLE_ORDER.items() for x in kv])[F.col("role")]
    n = members.groupBy("module", "role").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("module").agg(F.min(F.struct((-F.col("n")).alias("neg"), rank.alias("rank"), "role")).alias("m"))
    return best.select("module", F.col("m.role").alias("role"), (-F.col("m.neg")).alias("n"))


def module_priority(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """position, module: products first, then by a thousand times the in-degree plus the symbols, then by name.

    modules: module, role, n_symbols; edges: from_module, to_module.
    """
    deg = edges.where("from_module <> to_module").groupBy(F.col("to_module").alias("module")).agg(F.count_distinct("from_module").alias("in_degree"))
    m = modules.join(deg, "module", "left").withColumn("priority", F.coalesce("in_degree", F.lit(0)) * 1000 + F.coalesce("n_symbols", F.lit(0)))
    first = F.when(F.col("role") == "product", 0).otherwise(1)
    # the order over all modules comes from a sort by ranges; positions are given by the driver's small table of modules only on writing
    return m.select("module", "role", "priority", first.alias("tier")).orderBy("tier", F.desc("priority"), "module")


def related_modules(edges: DataFrame, priority: DataFrame, top: int = 3) -> DataFrame:
    """module, other, uses, used_by: of each module the `top` related ones, products first, then by priority and name."""
    e = edges.select(F.col("from_module").alias("module"), F.col("to_module").alias("other"), F.lit(True).alias("uses"), F.lit(False).alias("used_by"))
    r = edges.select(F.col("to_module").alias("module"), F.col("from_module").alias("other"), F.lit(False).alias("uses"), F.lit(True).alias("used_by"))
    both = e.unionByName(r).groupBy("module", "other").agg(F.max("uses").alias("uses"), F.max("used_by").alias("used_by"))
    j = both.join(priority.select(F.col("module").alias("other"), "tier", "priority"), "other")
    w = Window.partitionBy("module").orderBy("tier", F.desc("priority"), "other")
    return j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).select("module", "other", "uses", "used_by", "rn")


def module_bytes(members: DataFrame) -> DataFrame:
    return members.groupBy("module").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_files"))


def folder_coverage(units: DataFrame) -> DataFrame:
    """folder, pages, uncovered: files with symbols per folder, and those without a paired test, floored at 0. units: path, disposition."""
    p = units.groupBy(dir_name(F.col("path")).alias("folder")).agg(F.count_if(F.col("disposition") == "page").alias("pages"), F.count_if(F.col("disposition") == "test-paired").alias("tests"))
    return p.select("folder", "pages", F.greatest(F.lit(0), F.col("pages") - F.col("tests")).alias("uncovered"))


def class_methods(symbols: DataFrame) -> DataFrame:
    """file_id, class_name, methods: the methods of each class by name, joined by commas."""
    m = symbols.where("status = 'active' and kind = 'method' and instr(name, '.') > 0")
    cls = F.substring_index("name", ".", 1)
    return m.groupBy("file_id", cls.alias("class_name")).agg(F.array_join(F.sort_array(F.collect_set(F.substring("name", F.length(cls) + 2, F.length("name")))), ",").alias("methods"))


def round_robin(items: DataFrame, tier: str, group: str, order: list, keep: int) -> DataFrame:
    """The first `keep` items tier by tier, in each tier one of every group in turn."""
    w = Window.partitionBy(tier, group).orderBy(*order)
    return items.withColumn("turn", F.row_number().over(w)).orderBy(tier, "turn", group).limit(keep)


def cluster_cap(members: DataFrame, most: int = 6, least_product: int = 2) -> DataFrame:
    """Of each cluster at most `most` members: auxiliary ones go first, products down to least_product. members: cluster, id, kind, weight."""
    w = Window.partitionBy("cluster").orderBy(F.when(F.col("kind") == "product", 0).otherwise(1), F.desc("weight"), "id")
    return members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(most, least_product)).drop("rn")


def concern_groups(members: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """concern, module, surface, n_paths: modules with paths of a concern; surface is the first such path. members: module, path.
    rules: by concern the condition on path; default: paths of deployment, and of tests and fixtures."""
    if rules is None:
        rules = {"Deployment": matches_any(F.col("path"), DEPLOYMENT_PATTERNS), "Testing": path_role(F.col("path")).isin("fixture", "test")}
    tagged = members.select("module", "path", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))).alias("concern"))
    return tagged.groupBy("concern", "module").agg(F.min("path").alias("surface"), F.count(F.lit(1)).alias("n_paths"))


def choose_anchors(items: DataFrame, most: int, budget: int, product_share: float = 0.75) -> DataFrame:
    """cluster, position, id: of each cluster's items one of every group first, then groups in turn, as long as their sizes fit the budget
    and, once chosen, at least product_share of them are products.

    items: cluster, group, id, chars, is_product, weight. Each decision needs the ones before it, so a cluster's items pass by one task in
    order, in batches: they are sorted, not collected, and none is left out.
    """
    order = [F.when(F.col("is_product"), 0).otherwise(1), F.desc("weight"), "chars", "id"]
    turns = items.withColumn("turn", F.row_number().over(Window.partitionBy("cluster", "group").orderBy(*order))).where(F.col("chars") <= budget)
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cluster, chosen, used, products = object(), 0, 0, 0
        for b in batches:
            out = []
            for c, id, chars, is_product in zip(b["cluster"], b["id"], b["chars"], b["is_product"]):
                if c != cluster:
                    cluster, chosen, used, products = c, 0, 0, 0
                if chosen >= most or used + chars > budget or (not is_product and products < product_share * (chosen + 1)):
                    continue
                chosen, used, products = chosen + 1, used + chars, products + bool(is_product)
                out.append((c, chosen, id))
            yield pd.DataFrame(out, columns=["cluster", "position", "id"])

    ordered = turns.where("cluster is not null").repartition("cluster").sortWithinPartitions("cluster", "turn", "group", "id").select("cluster", "id", "chars", "is_product")
    return ordered.mapInPandas(run, f"cluster {kinds['cluster']}, position int, id {kinds['id']}")

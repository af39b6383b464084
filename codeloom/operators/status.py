"""Status reports: counts, open debt, and its order by risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import key_path, narrow_test, path_role, tier
from codeloom.functions.text import bands

#: points of events, of missing tests and of the bands of importers and commits (fixed values)
EVENT_POINTS = {"changed": 10, "deleted": 10, "moved": 5}
UNCOVERED, PROSE = 40, 10
FAN_IN_BANDS = [(1, 5), (3, 10), (6, 15), (11, 20)]
CHURN_BANDS = [(1, 5), (4, 10), (10, 15)]


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def top_files(files: DataFrame, symbols: DataFrame, top: int = 10) -> DataFrame:
    """The active files with the most active symbols, ties by path."""
    n = symbols.where("status = 'active'").groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("n_symbols"))
    return files.where("status = 'active'").join(n, "id").orderBy(F.desc("n_symbols"), "path").limit(top).select("path", "n_symbols")


def debt_by_role(debt: DataFrame, files: DataFrame, samples: int = 20) -> DataFrame:
    """Per role of the symbol's path: how many open debts, and the first keys. Keys without an active file are under no role; total counts all."""
    live = files.where("status = 'active'").select("path").distinct()
    d = debt.withColumn("path", key_path(F.col("symbol_key"))).join(live, "path", "left_semi").withColumn("role", path_role(F.col("path")))
    # the first keys of each slice of a role, then of the role: a role may hold most of the rows
    salted = d.select("role", "symbol_key", F.pmod(F.xxhash64("symbol_key"), F.lit(64)).alias("slice"))
    part = salted.withColumn("rn", F.row_number().over(Window.partitionBy("role", "slice").orderBy("symbol_key"))).where(F.col("rn") <= samples)
    top = part.withColumn("rn", F.row_number().over(Window.partitionBy("role").orderBy("symbol_key"))).where(F.col("rn") <= samples)
    lists = top.groupBy("role").agg(F.array_join(F.sort_array(F.collect_list("symbol_key")), ",").alias("samples"))
    total = debt.agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(1))
    return d.groupBy("role").agg(F.count(F.lit(1)).alias("n")).join(lists, "role").withColumn("one", F.lit(1)).join(total, "one").drop("one")


def debt_counts(debt: DataFrame) -> DataFrame:
    """One row: open debts by event and by assignee, 0 where there are none."""
    one = lambda c, v: F.count_if(F.col(c) == v)
    return debt.agg(*[one("event", e).alias(e) for e in sorted(EVENT_POINTS)], *[one("assignee", a).alias(a) for a in ("agent", "human")], F.count(F.lit(1)).alias("total"))


def fan_in(edges: DataFrame) -> DataFrame:
    """path, fan_in, covered: distinct importers of each file, and whether one of them is a test."""
    return edges.groupBy(F.col("to_file").alias("path")).agg(F.count_distinct("from_file").alias("fan_in"), F.max(narrow_test(F.col("from_file"))).alias("covered"))


def risk_score(event: Column, tier_: Column, covered: Column, importers: Column, commits: Column) -> Column:
    event_points = F.coalesce(F.create_map(*[F.lit(x) for kv in EVENT_POINTS.items() for x in kv])[event], F.lit(0))
    gap = F.when((tier_ == "anchored") & ~F.coalesce(covered, F.lit(False)), UNCOVERED).when(tier_ == "prose", PROSE).otherwise(0)
    fan = F.when(tier_ == "anchored", bands(F.coalesce(importers, F.lit(0)), FAN_IN_BANDS)).otherwise(0)
    return event_points + gap + fan + bands(F.coalesce(commits, F.lit(0)), CHURN_BANDS)


def risk_ranked(debt: DataFrame, files: DataFrame, edges: DataFrame, churn: DataFrame) -> DataFrame:
    """Debt with its score, highest first, then oldest, then by id. debt: id, symbol_key, event, detected_at; churn: path, commits."""
    f = files.where("status = 'active'").groupBy("path").agg(F.max(tier(F.lower(F.trim("lang")))).alias("tier"))
    d = debt.withColumn("path", key_path(F.col("symbol_key"))).join(f, "path", "left").join(fan_in(edges), "path", "left").join(churn.select("path", "commits"), "path", "left")
    score = risk_score(F.col("event"), F.col("tier"), F.col("covered"), F.col("fan_in"), F.col("commits"))
    return d.withColumn("score", score).orderBy(F.desc("score"), "detected_at", "id").select("id", "symbol_key", "event", "score", "detected_at")


def freshness(stored: DataFrame, present: DataFrame) -> DataFrame:
    """One row: files on record, missing ones, and those changed since they were indexed. stored: path, indexed_at; present: path, mtime."""
    j = stored.join(present.select("path", F.col("mtime").alias("now"), F.lit(True).alias("there")), "path", "left")
    return j.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("now") > F.col("indexed_at")).alias("newer"))


def badges(pages: DataFrame, days: int = 7) -> DataFrame:
    """wiki_path, badge: `new` if first seen within `days` of the newest change of all pages, else `updated` if changed within them, else none.

    pages: wiki_path, first_at, last_at in epoch milliseconds."""
    newest = pages.agg(F.max("last_at").alias("newest")).withColumn("one", F.lit(1))
    since = F.col("newest") - F.lit(days * 86_400_000)
    badge = F.when(F.col("first_at") >= since, "new").when(F.col("last_at") >= since, "updated").otherwise("none")
    return pages.withColumn("one", F.lit(1)).join(newest, "one").select("wiki_path", badge.alias("badge"))


def budget_rows(df: DataFrame, by: list[str], order: list, keep: int) -> DataFrame:
    """The first `keep` rows of each group, with the group's whole number of rows as total."""
    w = Window.partitionBy(*by)
    return df.withColumns({"rn": F.row_number().over(w.orderBy(*order)), "total": F.count(F.lit(1)).over(w)}).where(F.col("rn") <= keep)


def budget_chars(df: DataFrame, by: list[str], order: list, text: str, most: int) -> DataFrame:
    """Rows of each group in order as long as their texts, with a line end each, fit into `most` characters; the first that doesn't fit ends it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(F.length(text) + 1).over(w)).where(F.col("used") <= most)


def fair_share(df: DataFrame, by: list[str], text: str, most: int, least: int = 128) -> DataFrame:
    """Each text of a group cut to an equal share of `most` characters, at least `least`."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn(text, F.substring(F.col(text), F.lit(1), F.greatest(F.lit(least), F.floor(F.lit(most) / n)).cast("int")))

"""What a set of changed files touches: symbols, pages, importers; and what a working tree would change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import key_path
from codeloom.operators.resolve import direct_importers
from codeloom.operators.status import budget_rows

BUDGETS = {"symbol": 50, "page": 20, "importer": 25}


def change_impact(changed: DataFrame, symbols: DataFrame, duty: DataFrame, edges: DataFrame, budgets: dict[str, int] = BUDGETS) -> DataFrame:
    """what, name, rn, total: symbols of the changed files, pages that document them, and importers; the first of each kind within its
    budget, with the whole number as total. changed: path; duty: wiki_path, symbol_key; edges: from_file, to_file."""
    c = changed.select("path").distinct()
    s = symbols.where("status = 'active'").select(F.col("key").alias("name"), key_path(F.col("key")).alias("path")).join(c, "path", "left_semi").select("name").distinct()
    p = duty.join(s.select(F.col("name").alias("symbol_key")), "symbol_key", "left_semi").select(F.col("wiki_path").alias("name")).distinct()
    i = direct_importers(edges, c).select(F.col("path").alias("name"))
    out = None
    for what, df in (("symbol", s), ("page", p), ("importer", i)):
        # the budget is met by a sort with a limit, the total by a count, so no kind's rows meet in one task
        first = df.orderBy("name").limit(budgets[what]).withColumn("what", F.lit(what))
        total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("what", F.lit(what))
        rows = budget_rows(first, ["what"], ["name"], budgets[what]).drop("total").join(total, "what").select("what", "name", "rn", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


def affected_pages(keys: DataFrame, anchored: DataFrame) -> DataFrame:
    """wiki_path, symbol_key: the pages that document one of the symbols, once each. keys: symbol_key; anchored: wiki_path, symbol_key."""
    return anchored.join(keys.select("symbol_key"), "symbol_key", "left_semi").select("wiki_path", "symbol_key").distinct()


def working_tree_preview(duty: DataFrame, baseline: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """wiki_path, symbol_key, event: what the anchors to changed files would become. fresh: key, content_hash of symbols extracted anew
    from the changed files; baseline: wiki_path, symbol_key, hash; event is `changed`, `deleted` or `clean`."""
    d = duty.select("wiki_path", "symbol_key", key_path(F.col("symbol_key")).alias("path")).join(changed.select("path").distinct(), "path", "left_semi")
    j = d.join(baseline.select("wiki_path", "symbol_key", "hash"), ["wiki_path", "symbol_key"]).join(fresh.select(F.col("key").alias("symbol_key"), F.col("content_hash").alias("now")), "symbol_key", "left")
    event = F.when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("hash"), "clean").otherwise("changed")
    return j.select("wiki_path", "symbol_key", event.alias("event"))

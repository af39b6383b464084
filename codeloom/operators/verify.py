"""Checks of pages against symbols, other pages and what was stored, as rows of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import normal_key
from codeloom.functions.paths import resolve_relative
from codeloom.operators.baseline_ops import validate


def page_anchor_rows(pages: DataFrame) -> DataFrame:
    """wiki_path, section_slug (null for the page), symbol_key of every anchor of parsed pages."""
    a = pages.select("wiki_path", F.lit(None).cast("string").alias("section_slug"), F.explode("page_anchors").alias("raw"))
    s = pages.select("wiki_path", F.explode("section_anchors").alias("s")).select("wiki_path", F.col("s.section_slug").alias("section_slug"), F.explode("s.symbol_keys").alias("raw"))
    return a.unionByName(s).select("wiki_path", "section_slug", normal_key(F.col("raw")).alias("symbol_key")).where("symbol_key is not null")


def broken_anchors(pages: DataFrame, symbols: DataFrame) -> DataFrame:
    live = symbols.where("status = 'active'").select(F.col("key").alias("symbol_key")).distinct()
    return page_anchor_rows(pages).distinct().join(live, "symbol_key", "left_anti").select("wiki_path", F.lit("broken_anchor").alias("issue"), F.col("symbol_key").alias("detail"))


def think_blocks(pages: DataFrame) -> DataFrame:
    return pages.where("think_block").select("wiki_path", F.lit("think_block_present").alias("issue"), F.lit("").alias("detail"))


def malformed_heads(pages: DataFrame) -> DataFrame:
    return pages.where("error is not null").select("wiki_path", F.lit("malformed_frontmatter").alias("issue"), F.col("error").alias("detail"))


def altered_blocks(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored manual blocks that no equal block of the page stands for; each current block answers for one. stored: wiki_path, content_hash."""
    now = pages.select("wiki_path", F.explode("manual_blocks").alias("b")).select("wiki_path", F.sha2("b.text", 256).alias("content_hash"))
    return stored.select("wiki_path", "content_hash").exceptAll(now).select("wiki_path", F.lit("manual_block_altered").alias("issue"), F.col("content_hash").alias("detail"))


def broken_links(pages: DataFrame) -> DataFrame:
    """Links to pages that don't exist, lead out of the root, or name a section that the page doesn't have."""
    links = pages.select("wiki_path", F.explode("links").alias("l")).select("wiki_path", F.col("l.target").alias("target"))
    links = links.where(~F.col("target").rlike(r"^[a-z][a-z0-9+.-]*:|^//|^mailto"))
    file_part, section = F.regexp_extract("target", r"^([^#]*)", 1), F.regexp_extract("target", r"#(.*)$", 1)
    links = links.select("wiki_path", "target", section.alias("section"), F.when(file_part == "", F.col("wiki_path")).otherwise(resolve_relative(F.col("wiki_path"), file_part)).alias("to"))
    links = links.where(F.col("to").rlike(r"\.md$|^\.\."))
    known = pages.select(F.col("wiki_path").alias("to"), "all_slugs").dropDuplicates(["to"])
    j = links.join(known, "to", "left")
    kind = (
        F.when(F.col("to").startswith(".."), "outside")
        .when(F.col("all_slugs").isNull(), "page")
        .when((F.col("section") != "") & ~F.array_contains("all_slugs", F.col("section")), "section")
    )
    return j.withColumn("kind", kind).where("kind is not null").select("wiki_path", F.concat_ws("_", F.lit("broken_internal_link"), "kind").alias("issue"), F.col("target").alias("detail")).distinct()


def missing_pages(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages on record whose file is gone."""
    return stored.select("wiki_path").distinct().join(pages.select("wiki_path").distinct(), "wiki_path", "left_anti").select("wiki_path", F.lit("missing_wiki_path").alias("issue"), F.lit("").alias("detail"))


def baseline_problems(baseline: DataFrame, anchored: DataFrame) -> DataFrame:
    """Entries of a baseline that can't be read, `unsupported_baseline_algorithm` or `invalid_documentation_baseline`, and, if there are none
    of these, entries that no page has an anchor for. baseline: as baseline_ops has it; anchored: wiki_path, symbol_key."""
    faults = validate(baseline)
    code = F.when(F.col("issue") == "unknown_extraction", "unsupported_baseline_algorithm").otherwise("invalid_documentation_baseline")
    unread = faults.select("wiki_path", code.alias("issue"), F.concat_ws(": ", F.coalesce("symbol_key", F.lit("")), F.col("issue")).alias("detail"))
    whole = faults.agg(F.count(F.lit(1)).alias("faults")).where("faults = 0")  # one row, or none if the baseline can't be read
    lost = baseline.select("wiki_path", "symbol_key").distinct().join(anchored.select("wiki_path", "symbol_key"), ["wiki_path", "symbol_key"], "left_anti")
    lost = lost.withColumn("faults", F.lit(0).cast("long")).join(F.broadcast(whole), "faults", "left_semi")
    return unread.unionByName(lost.select("wiki_path", F.lit("baseline_entry_without_anchor").alias("issue"), F.col("symbol_key").alias("detail")))


def verify_pages(pages: DataFrame, symbols: DataFrame, stored_pages: DataFrame, stored_blocks: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """wiki_path, issue, detail of every check; blocks and a baseline are checked where they are given."""
    checks = [broken_anchors(pages, symbols), think_blocks(pages), malformed_heads(pages), broken_links(pages), missing_pages(stored_pages, pages)]
    if stored_blocks is not None:
        checks.append(altered_blocks(stored_blocks, pages))
    if baseline is not None:
        checks.append(baseline_problems(baseline, page_anchor_rows(pages)))
    return reduce(DataFrame.unionByName, checks)

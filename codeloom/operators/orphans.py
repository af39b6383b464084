"""References to records that do not exist, direct and inherited, per table and period.

One cascade serves every query: references whose record is missing, deleted or late are direct orphans; records that hold such
a reference to a missing or deleted one are orphaned records, and whatever refers to them is an orphan by inheritance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import normal_key, normal_word, utc_month
from codeloom.plans.lineage import cut


def anchor_references(anchors: DataFrame) -> DataFrame:
    """The symbol keys that extracted pages refer to: ref_table, symbol_key as written, recorded_at. Null arrays and elements give none."""
    page = anchors.select(F.lit("page_anchors").alias("ref_table"), "recorded_at", F.explode("page_anchors").alias("raw"))
    section = anchors.select("recorded_at", F.explode("section_anchors").alias("s")).select(F.lit("section_anchors").alias("ref_table"), "recorded_at", F.explode("s.symbol_keys").alias("raw"))
    return page.unionByName(section)


def symbol_references(calls: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row per (ref_table, ref_month, symbol_key): first_at (its earliest referring row) and n_refs.

    Null, empty and blank keys are no references. A referring row without recorded_at has a null month and can't be too early.
    Rows are summed up before they are shuffled, so that a key that a large share of the rows holds makes no large task.
    """
    refs = calls.select(F.lit("calls").alias("ref_table"), "recorded_at", F.col("resolved_callee_key").alias("raw")).unionByName(anchor_references(anchors))
    return (
        refs.where(F.col("raw").isNotNull())
        .select("ref_table", utc_month(F.col("recorded_at")).alias("ref_month"), normal_key(F.col("raw")).alias("symbol_key"), "recorded_at")
        .where(F.col("symbol_key").isNotNull())
        .groupBy("ref_table", "ref_month", "symbol_key")
        .agg(F.min("recorded_at").alias("first_at"), F.count(F.lit(1)).alias("n_refs"))
    )


def known_keys(*tables: DataFrame) -> DataFrame:
    """One row per symbol key of the tables: is_active, active_at (from when on an active row has it, null if always), and the file and
    time of its active row, or else of its last row by id: file_id, recorded_at."""
    live = F.coalesce(normal_word(F.col("status")) == "active", F.lit(False))
    columns = [normal_key(F.col("key")).alias("symbol_key"), live.alias("live"), "recorded_at", "file_id", "id"]
    rows = reduce(DataFrame.unionByName, [t.select(*columns) for t in tables])
    last = F.max(F.struct("live", "id", "file_id", "recorded_at"))
    return (
        rows.where(F.col("symbol_key").isNotNull())
        .groupBy("symbol_key")
        .agg(
            F.max("live").alias("is_active"),
            F.min(F.when(F.col("live"), F.col("recorded_at"))).alias("active_at"),
            F.max(F.col("live") & F.col("recorded_at").isNull()).alias("always"),
            last.alias("last"),
        )
        .select("symbol_key", "is_active", F.when(~F.col("always"), F.col("active_at")).alias("active_at"), "last.file_id", "last.recorded_at")
    )


def orphan_cascade(records: DataFrame, references: DataFrame, depth: int | None = None) -> DataFrame:
    """Orphaned references of a foreign-key graph, found by a fixpoint of semi-joins down the graph.

    records: table, key (unique), is_active, active_at - the records that exist, and from when on (null if always).
    references: table, key, parent, parent_key, period, first_at, n_refs - that records of `table` refer to (parent, parent_key)
    n_refs times in `period`, first at first_at (null: can't be too early). key is the referring record's own, null where nothing refers to
    records of that table, so that its rows may be summed up. A null parent_key is no reference.

    A reference is `direct`, level 0, if its record is `missing`, `deleted` (there, but not active) or `late` (active from after
    first_at on). A record with a missing or deleted reference is an orphan, and so, level by level, is each record that refers to
    an orphan; a record becomes one once only, so cycles end. References to orphaned records that aren't direct are `inherited`,
    with the reason `orphaned` and one level more than the record's. A late reference orphans nobody, as its record is there now.

    Returns the references' columns but first_at, with kind, reason, level and above: for each reference, direct ones too, whose record
    is an orphan itself, one level more than the record's (a symbol that went with its file), else null. depth: levels of inheritance
    at most; None: to the fixpoint. records are read several times, so hand over written ones. Only references with a key take part in the iteration, one semi-join with the orphans found last per level, and each
    level is written to the shared folder once; the others are joined once, with the result.
    """
    records = records.select(F.col("table").alias("parent"), F.col("key").alias("parent_key"), "is_active", "active_at")
    at = ["parent", "parent_key"]
    refs = references.where(F.col("parent_key").isNotNull())
    inner = refs.where(F.col("key").isNotNull()).select("table", "key", *at)
    lost = inner.join(records.where("is_active"), at, "left_anti")
    last = cut(lost.select("table", "key").distinct().withColumn("level", F.lit(0)))
    levels = [last]
    while not last.isEmpty() and (depth is None or len(levels) < depth):
        above = last.select(F.col("table").alias("parent"), F.col("key").alias("parent_key"))
        known = reduce(DataFrame.unionByName, levels).select("table", "key")  # each level was written once and isn't written again
        step = inner.join(above, at, "left_semi").select("table", "key").distinct().join(known, ["table", "key"], "left_anti")
        last = cut(step.withColumn("level", F.lit(len(levels))))
        levels.append(last)
    orphans = reduce(DataFrame.unionByName, levels).select(F.col("table").alias("parent"), F.col("key").alias("parent_key"), "level")
    states = records.join(orphans, at, "left")
    direct = F.when(F.col("is_active").isNull(), "missing").when(~F.col("is_active"), "deleted").when(F.col("active_at") > F.col("first_at"), "late")
    inherited = F.col("level").isNotNull() & F.lit(depth is None or depth > 0)
    found = refs.join(states, at, "left").withColumn("direct", direct).where(F.col("direct").isNotNull() | inherited)
    return found.select(
        "table", "key", *at, "period", "n_refs",
        F.when(F.col("direct").isNotNull(), "direct").otherwise("inherited").alias("kind"),
        F.coalesce("direct", F.lit("orphaned")).alias("reason"),
        F.when(F.col("direct").isNotNull(), 0).otherwise(F.col("level") + 1).alias("level"),
        (F.col("level") + 1).alias("above"),
    )


def workspace_records(files: DataFrame, symbols: DataFrame, shared: DataFrame, pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """The records of the workspace as orphan_cascade takes them: files and pages by id, symbols by key, extractions by their page's id.
    Symbols have their file_id and their period too."""

    def always(df: DataFrame, name: str, key: Column, live: Column) -> DataFrame:
        there = df.where(key.isNotNull()).groupBy(key.cast("string").alias("key")).agg(F.max(live).alias("is_active"))
        return there.select(F.lit(name).alias("table"), "key", "is_active", *[F.lit(None).cast(t).alias(n) for n, t in (("active_at", "timestamp"), ("file_id", "string"), ("period", "string"))])

    live = F.coalesce(normal_word(F.col("status")) == "active", F.lit(False))
    symbol = known_keys(symbols, shared).select(F.lit("symbols").alias("table"), F.col("symbol_key").alias("key"), "is_active", "active_at", F.col("file_id").cast("string").alias("file_id"), utc_month(F.col("recorded_at")).alias("period"))
    return (
        symbol.unionByName(always(files, "files", F.col("id"), live))
        .unionByName(always(pages, "doc_pages", F.col("id"), F.lit(True)))
        .unionByName(always(anchors, "extracted_anchors", F.col("doc_page_id"), F.lit(True)))
    )


def workspace_references(records: DataFrame, calls: DataFrame, anchors: DataFrame) -> DataFrame:
    """What refers to what: calls, their callers and anchors to symbols, anchors to the extraction that holds them, extractions to pages,
    symbols to their file and, where the key names one (`path#Class.method`), to their class. Sums per month and key.

    records: as workspace_records gives them; a deleted symbol refers to its file and class as well.
    """
    none = F.lit(None)

    def refs(df: DataFrame, table: Column, key: Column, parent: str, parent_key: Column, first: Column, n: Column) -> DataFrame:
        return df.select(table.alias("table"), key.cast("string").alias("key"), F.lit(parent).alias("parent"), parent_key.cast("string").alias("parent_key"), "period", first.cast("timestamp").alias("first_at"), n.cast("long").alias("n_refs"))

    def keys_in(array: Column) -> Column:
        return F.size(F.filter(F.coalesce(array, F.array().cast("array<string>")), lambda k: normal_key(k).isNotNull()))

    month = utc_month(F.col("recorded_at")).alias("period")
    keyed = symbol_references(calls, anchors).withColumnRenamed("ref_month", "period")
    callers = calls.where("caller_key is not null").groupBy(month, "caller_key").agg(F.count(F.lit(1)).alias("n"))  # summed up before the keys are respelled
    callers = callers.groupBy("period", normal_key(F.col("caller_key")).alias("k")).agg(F.sum("n").alias("n"))
    paged = anchors.where("doc_page_id is not null")
    sections = F.coalesce(F.aggregate("section_anchors", F.lit(0), lambda n, s: n + keys_in(s["symbol_keys"])), F.lit(0))
    held = paged.select(month, "doc_page_id", F.explode(F.create_map(F.lit("page_anchors"), keys_in(F.col("page_anchors")), F.lit("section_anchors"), sections)).alias("t", "n"))
    held = held.where("n > 0").groupBy("period", "doc_page_id", "t").agg(F.sum("n").alias("n"))
    pages = paged.groupBy(month, "doc_page_id").agg(F.count(F.lit(1)).alias("n"))
    own = records.where(F.col("table") == "symbols").select("period", F.col("key").alias("k"), "file_id")
    holder = F.when(F.instr(F.substring_index("k", "#", -1), ".") > 0, F.regexp_replace("k", r"\.[^.]*$", ""))
    one = F.lit(1)
    return reduce(
        DataFrame.unionByName,
        [
            refs(keyed, F.col("ref_table"), none, "symbols", F.col("symbol_key"), F.col("first_at"), F.col("n_refs")),
            refs(callers, F.lit("callers"), none, "symbols", F.col("k"), none, F.col("n")),
            refs(held, F.col("t"), none, "extracted_anchors", F.col("doc_page_id"), none, F.col("n")),
            refs(pages, F.lit("extracted_anchors"), F.col("doc_page_id"), "doc_pages", F.col("doc_page_id"), none, F.col("n")),
            refs(own, F.lit("symbols"), F.col("k"), "files", F.col("file_id"), none, one),
            refs(own, F.lit("symbols"), F.col("k"), "symbols", holder, none, one),
        ],
    )


def workspace_orphans(files: DataFrame, symbols: DataFrame, shared: DataFrame, calls: DataFrame, pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every orphaned reference of the workspace, direct or inherited, as orphan_cascade gives them: what the queries of this problem read."""
    records = cut(workspace_records(files, symbols, shared, pages, anchors))
    return orphan_cascade(records, workspace_references(records, calls, anchors))


def direct_symbol_orphans(found: DataFrame) -> DataFrame:
    """ref_table, ref_month, symbol_key, reason, n_refs of the cascade's level 0: symbol keys held by calls and anchors that no record answers."""
    mine = found.where((F.col("kind") == "direct") & (F.col("parent") == "symbols") & F.col("table").isin("calls", "page_anchors", "section_anchors"))
    return mine.select(F.col("table").alias("ref_table"), F.col("period").alias("ref_month"), F.col("parent_key").alias("symbol_key"), "reason", "n_refs")


def orphan_report(found: DataFrame) -> DataFrame:
    """Per referring table, parent table, month, kind and reason: n_keys (distinct orphaned references), n_refs, n_above (keys whose record is
    an orphan itself) and the deepest level."""
    return found.groupBy(F.col("table").alias("ref_table"), F.col("parent").alias("parent_table"), F.col("period").alias("ref_month"), "kind", "reason").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n_refs").alias("n_refs"), F.count("above").alias("n_above"), F.max(F.coalesce("above", "level")).alias("max_level")
    )

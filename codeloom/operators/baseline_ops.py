"""Changes to an accepted baseline, each giving a new table, and the checks a baseline must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import extraction_version

ENTRY = ["wiki_path", "symbol_key"]
COLUMNS = [*ENTRY, "hash", "extraction", "provenance"]


def bootstrap(duty: DataFrame, symbols: DataFrame, provenance: str = "inferred") -> DataFrame:
    """A first baseline: every obligation whose symbol is there, with the symbol's present hash. symbols: key, content_hash."""
    s = symbols.select(F.col("key").alias("symbol_key"), F.col("content_hash").alias("hash"))
    return duty.select(*ENTRY).distinct().join(s, "symbol_key").select(*ENTRY, "hash", extraction_version(F.col("symbol_key")).alias("extraction"), F.lit(provenance).alias("provenance"))


def accept(baseline: DataFrame, chosen: DataFrame, symbols: DataFrame) -> DataFrame:
    """The baseline with the chosen (wiki_path, symbol_key) accepted at their present hashes, new ones added; a gone symbol changes nothing."""
    fresh = bootstrap(chosen, symbols, "accepted")
    return baseline.select(*COLUMNS).join(fresh.select(*ENTRY), ENTRY, "left_anti").unionByName(fresh)


def move(baseline: DataFrame, moves: DataFrame) -> DataFrame:
    """Entries renamed by moves (wiki_path, symbol_key, moved_to); where the new entry is there already, the old one goes."""
    m = moves.select(*ENTRY, "moved_to").dropDuplicates(ENTRY)
    j = baseline.select(*COLUMNS).join(m, ENTRY, "left").withColumn("symbol_key", F.coalesce("moved_to", "symbol_key"))
    first = F.max(F.struct(F.col("moved_to").isNull().alias("own"), "hash", "extraction", "provenance")).alias("m")
    return j.groupBy(*ENTRY).agg(first).select(*ENTRY, "m.hash", "m.extraction", "m.provenance")


def remove(baseline: DataFrame, gone: DataFrame) -> DataFrame:
    return baseline.select(*COLUMNS).join(gone.select(*ENTRY), ENTRY, "left_anti")


def relocate(baseline: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries of pages that were renamed. pages: wiki_path, new_path."""
    j = baseline.join(pages.select("wiki_path", "new_path").dropDuplicates(["wiki_path"]), "wiki_path", "left")
    return j.withColumn("wiki_path", F.coalesce("new_path", "wiki_path")).select(*COLUMNS).dropDuplicates(ENTRY)


def advance(baseline: DataFrame, states: DataFrame, symbols: DataFrame) -> DataFrame:
    """The baseline with every entry whose state is `clean` or `changed` at its symbol's present hash, others as they are."""
    now = states.where("state in ('clean', 'changed')").select(*ENTRY).join(symbols.select(F.col("key").alias("symbol_key"), F.col("content_hash").alias("now")), "symbol_key")
    return baseline.select(*COLUMNS).join(now, ENTRY, "left").withColumn("hash", F.coalesce("now", "hash")).select(*COLUMNS)


def validate(baseline: DataFrame) -> DataFrame:
    """wiki_path, symbol_key, issue of entries that a baseline must not have."""
    b = baseline.select(*COLUMNS)
    checks = {
        "no_path": F.coalesce(F.trim("wiki_path"), F.lit("")) == "",
        "path_leaves_root": F.col("wiki_path").rlike(r"^/|(^|/)\.\.(/|$)"),
        "malformed_key": F.coalesce(~F.col("symbol_key").rlike(r"^[^#]+#.+$"), F.lit(True)),
        "malformed_hash": F.coalesce(~F.col("hash").rlike("^[0-9a-f]{64}$"), F.lit(True)),
        "unknown_extraction": ~F.col("extraction").eqNullSafe(extraction_version(F.col("symbol_key"))),
        "unknown_provenance": F.coalesce(~F.col("provenance").isin("accepted", "inferred"), F.lit(True)),
    }
    rows = b.select(*ENTRY, F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))).alias("issue"))
    twice = b.groupBy(*ENTRY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*ENTRY, F.lit("duplicate").alias("issue"))
    return rows.unionByName(twice)


def canonical_lines(baseline: DataFrame) -> DataFrame:
    """line: one JSON object per entry with fixed field order, sorted by page and key."""
    return baseline.select(*COLUMNS).orderBy(*ENTRY).select(F.to_json(F.struct(*COLUMNS)).alias("line"))

"""Change detection: index plans, accepted baselines, moves, obligations, manual blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import normal_key
from codeloom.functions.paths import assignee, extraction_version, key_name
from codeloom.operators.resolve import latest


def index_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, action for the union of two states of the files: `insert`, `update`, `unchanged`, `reactivate`, `delete`, `gone`.

    old: path, content_hash, status; new: path, content_hash (what the walk found).
    """
    o = old.groupBy("path").agg(F.max(F.struct((F.col("status") == "active").alias("live"), F.col("content_hash").alias("h"))).alias("o"))
    n = new.groupBy("path").agg(F.max("content_hash").alias("new_hash"), F.max(F.lit(True)).alias("there"))
    j = o.join(n, "path", "full")
    action = (
        F.when(F.col("o").isNull(), "insert")
        .when(F.col("there").isNull(), F.when(F.col("o.live"), "delete").otherwise("gone"))
        .when(~F.col("o.live"), "reactivate")
        .when(F.col("o.h").eqNullSafe(F.col("new_hash")), "unchanged")
        .otherwise("update")
    )
    return j.select("path", action.alias("action"))


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def grammar_changes(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """ext, grammar, changed: for each ending whether its grammar came, went, is another one or was built anew. Both: ext, grammar, artifact.

    Without an old state, as in records from before it was kept, changed is null: only files without symbols are read again then.
    """
    if old is None:
        return new.select("ext", "grammar", F.lit(None).cast("boolean").alias("changed"))
    o = old.select("ext", F.col("grammar").alias("was"), F.col("artifact").alias("was_artifact"))
    j = o.join(new.select("ext", "grammar", "artifact"), "ext", "full")
    changed = ~F.col("was").eqNullSafe(F.col("grammar")) | (F.col("grammar").isNotNull() & ~F.col("was_artifact").eqNullSafe(F.col("artifact")))
    return j.select("ext", "grammar", changed.alias("changed"))


def file_plan(files: DataFrame, found: DataFrame, symbols: DataFrame, grammars: DataFrame | None = None) -> DataFrame:
    """path, action, reactivated of an index run over what a walk found: `add`, `update`, `unchanged`, `reprocess` (same content, but its
    grammar changed), `migrate` (only the way of hashing line ends differs from the record), `delete`, or `gone` (deleted before).

    files: id, path, content_hash, lang, status; found: path, lang, content; symbols: file_id, status; grammars: as grammar_changes gives
    them, null if no grammar changed. A file that was deleted and is back is reactivated and read again, whatever its content. A path is on record once.
    """
    from codeloom.functions.paths import extension
    from codeloom.functions.text import content_digest, expand_eol

    text = F.col("content")
    now = found.select("path", F.col("lang").alias("now_lang"), content_digest(text).alias("now"), F.sha2(text, 256).alias("raw"), F.when(~F.contains(text, F.lit("\r\n")), F.sha2(expand_eol(text), 256)).alias("crlf"), F.lit(True).alias("there"))
    told = symbols.where("status = 'active' and file_id is not null").select(F.col("file_id").alias("id")).distinct().withColumn("told", F.lit(True))
    was = files.select("id", "path", "content_hash", "lang", (F.col("status") == "active").alias("live")).join(told, "id", "left")
    j = was.withColumn("known", F.lit(True)).join(now, "path", "full").withColumn("ext", extension(F.col("path")))
    again = F.lit(False)
    if grammars is not None:
        legacy = grammars.agg(F.coalesce(F.max(F.col("changed").isNull()), F.lit(False)).alias("legacy")).withColumn("one", F.lit(1))
        j = j.join(F.broadcast(grammars), "ext", "left").withColumn("one", F.lit(1)).join(F.broadcast(legacy), "one")  # a row for each ending with a grammar, and one row
        silent = F.col("grammar").isNotNull() & F.col("told").isNull()
        # without an old state only silent files are read again
        again = silent | (~F.col("legacy") & (F.coalesce("changed", F.lit(False)) | ~F.col("lang").eqNullSafe(F.col("now_lang"))))
    same = F.col("content_hash") == F.col("now")
    action = (
        F.when(F.col("known").isNull(), "add")
        .when(F.col("there").isNull(), F.when(F.col("live"), "delete").otherwise("gone"))
        .when(same, F.when(F.col("live") & again, "reprocess").otherwise("unchanged"))
        .when((F.col("content_hash") == F.col("raw")) | (F.col("content_hash") == F.col("crlf")), "migrate")
        .otherwise("update")
    )
    return j.select("path", action.alias("action"), (F.coalesce(F.col("there") & ~F.col("live"), F.lit(False))).alias("reactivated"))


def index_counters(plan: DataFrame, verdicts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row with the counters of an index run. plan: as file_plan gives it; verdicts: file_id, verdict of scan_reasons; before, after: key of active symbols."""
    n = {"added": "add", "updated": "update", "deleted": "delete", "reprocessed_grammar": "reprocess"}
    files = plan.agg(
        F.count_if(F.col("action").isin("add", "update", "unchanged", "reprocess", "migrate")).alias("scanned"),
        *[F.count_if(F.col("action") == a).alias(c) for c, a in n.items()],
        F.count_if(F.col("action").isin("unchanged", "migrate")).alias("unchanged"),
        F.count_if(F.col("reactivated")).alias("reactivated"),
    )
    skipped = verdicts.agg(F.count_if(F.col("verdict") == "binary").alias("skipped_binary"), F.count_if(F.col("verdict") == "too large").alias("skipped_too_large"))
    a, b = before.select("key").distinct(), after.select("key").distinct()
    moved = b.withColumn("now", F.lit(1)).unionByName(a.withColumn("now", F.lit(-1))).groupBy("key").agg(F.sum("now").alias("n"))
    symbols = moved.agg(F.count_if(F.col("n") > 0).alias("symbols_added"), F.count_if(F.col("n") < 0).alias("symbols_deleted"))
    one = F.lit(1).alias("one")
    return files.select(one, "*").join(skipped.select(one, "*"), "one").join(symbols.select(one, "*"), "one").drop("one")  # single rows


def next_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, content_hash, status after a run: what the walk found is active, what it missed is deleted and keeps its hash."""
    o = old.groupBy("path").agg(F.max("content_hash").alias("old_hash"))
    n = new.groupBy("path").agg(F.max("content_hash").alias("new_hash"), F.max(F.lit(True)).alias("there"))
    return o.join(n, "path", "full").select("path", F.when(F.col("there"), F.col("new_hash")).otherwise(F.col("old_hash")).alias("content_hash"), F.when(F.col("there"), "active").otherwise("deleted").alias("status"))


def eol_migrations(contents: DataFrame, files: DataFrame) -> DataFrame:
    """file_id and proof of files whose stored hash differs from their text's hash in nothing but line ends: `raw` if it is the hash
    of the bytes as they are, `crlf` of the text with CR LF throughout, `same` if it is the normalised hash, else `changed`."""
    from codeloom.functions.text import content_digest, expand_eol

    j = contents.join(files.select(F.col("id").alias("file_id"), "content_hash"), "file_id")
    proof = (
        F.when(F.col("content_hash") == content_digest(F.col("content")), "same")
        .when(F.col("content_hash") == F.sha2("content", 256), "raw")
        .when(F.col("content_hash") == F.sha2(expand_eol(F.col("content")), 256), "crlf")
        .otherwise("changed")
    )
    return j.select("file_id", proof.alias("proof"))


def obligations(anchors: DataFrame) -> DataFrame:
    """wiki_path, symbol_key, assignee: what the pages, by their latest extraction, promise to document; one row per page and symbol.

    Page and section anchors count alike; a human's page or a manual block makes the assignee human. Null and blank keys are none.
    """
    last = latest(anchors.dropDuplicates(["wiki_path", "recorded_at"]), ["wiki_path"], [F.desc("recorded_at")])
    page = last.select("wiki_path", "owner", F.lit(False).alias("manual"), F.explode("page_anchors").alias("raw"))
    section = last.select("wiki_path", "owner", F.explode("section_anchors").alias("s")).select("wiki_path", "owner", F.col("s.in_manual_block").alias("manual"), F.explode("s.symbol_keys").alias("raw"))
    rows = page.unionByName(section).select("wiki_path", normal_key(F.col("raw")).alias("symbol_key"), (assignee(F.col("manual"), F.col("owner")) == "human").alias("human")).where("symbol_key is not null")
    return rows.groupBy("wiki_path", "symbol_key").agg(F.when(F.max("human"), "human").otherwise("agent").alias("assignee"))


def anchored_keys(anchors: DataFrame) -> DataFrame:
    """wiki_path, symbol_key of every page and section anchor of every extraction; null and blank keys are none."""
    page = anchors.select("wiki_path", F.explode("page_anchors").alias("raw"))
    section = anchors.select("wiki_path", F.explode("section_anchors").alias("s")).select("wiki_path", F.explode("s.symbol_keys").alias("raw"))
    return page.unionByName(section).select("wiki_path", normal_key(F.col("raw")).alias("symbol_key")).where("symbol_key is not null")


def evaluate_baseline(baseline: DataFrame, symbols: DataFrame, duty: DataFrame) -> DataFrame:
    """wiki_path, symbol_key, state, moved_to, assignee of each baseline entry and each obligation without one.

    state is `inferred`, `clean`, `changed`, `deleted`, `moved`, or `unbaselined` for an obligation without an entry; cited says
    whether the page still cites an entry. An entry is moved if it was accepted, is still cited, its symbol is gone, and exactly one
    active symbol has its hash, its kind of extraction and its name, that name is the only active one, and no other entry claims
    the same symbol.

    baseline: wiki_path, symbol_key, hash, extraction, provenance; symbols: key, name, content_hash of active ones; duty: as
    obligations gives it.
    """
    s = symbols.select("key", "name", "content_hash")
    at = ["wiki_path", "symbol_key"]
    b = baseline.join(s.select(F.col("key").alias("symbol_key"), F.col("content_hash").alias("now"), F.lit(True).alias("there")), "symbol_key", "left").join(duty, at, "left")
    names = s.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("name")
    single = s.join(names, "name").select(F.col("key").alias("new_key"), F.col("name").alias("old_name"), F.col("content_hash").alias("hash"), extraction_version(F.col("key")).alias("extraction"))
    gone = b.where("provenance = 'accepted' and there is null and assignee is not null").withColumn("old_name", key_name(F.col("symbol_key")))
    pairs = gone.join(single, ["old_name", "hash", "extraction"]).where("new_key <> symbol_key").select(*at, "new_key")
    one = pairs.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min("new_key").alias("new_key")).where("n = 1").drop("n")
    claims = pairs.groupBy("new_key").agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("new_key")
    moves = one.join(claims, "new_key").select(*at, F.col("new_key").alias("moved_to"))
    state = (
        F.when(F.col("provenance") == "inferred", "inferred")
        .when(F.col("there").isNull(), F.when(F.col("moved_to").isNotNull(), "moved").otherwise("deleted"))
        .when(F.col("now") == F.col("hash"), "clean")
        .otherwise("changed")
    )
    entries = b.join(moves, at, "left").select(*at, state.alias("state"), "moved_to", F.col("assignee").isNotNull().alias("cited"), F.coalesce("assignee", F.lit("agent")).alias("assignee"))
    fresh = duty.join(baseline.select(*at).distinct(), at, "left_anti").select(*at, F.lit("unbaselined").alias("state"), F.lit(None).cast("string").alias("moved_to"), F.lit(True).alias("cited"), "assignee")
    return entries.unionByName(fresh)


def legacy_moves(gone: DataFrame, symbols: DataFrame) -> DataFrame:
    """old_key, new_key: for symbols that went, the active one with the same hash (the last by id), else the first in another file with
    the same name and signature, nulls being equal; none where another active symbol of that name and kind stays.

    gone: key, file_id, name, kind, signature, content_hash; symbols: id and the same, active ones only.
    """
    by_hash = symbols.groupBy("content_hash").agg(F.max_by("key", "id").alias("hash_key"))
    twin = symbols.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("twins"))
    g = gone.join(by_hash, "content_hash", "left")
    s = symbols.select(F.col("id").alias("s_id"), F.col("key").alias("s_key"), F.col("file_id").alias("s_file"), "name", F.col("signature").alias("s_signature"))
    other = g.where("hash_key is null").join(s, "name").where(F.col("s_signature").eqNullSafe(F.col("signature")) & ~F.col("s_file").eqNullSafe(F.col("file_id")))
    first = other.groupBy("key").agg(F.min_by("s_key", "s_id").alias("name_key"))
    out = g.join(first, "key", "left").join(twin, ["name", "kind"], "left")
    found = F.coalesce("hash_key", F.when(F.coalesce("twins", F.lit(0)) <= 1, F.col("name_key")))
    return out.select(F.col("key").alias("old_key"), found.alias("new_key")).where("new_key is not null and new_key <> old_key")


def debt_sync(desired: DataFrame, stored: DataFrame) -> DataFrame:
    """wiki_path, symbol_key, event, action: `create`, `keep`, `promote` (now a human's) or `resolve`. Both: wiki_path, symbol_key, event, assignee."""
    at = ["wiki_path", "symbol_key", "event"]
    d = desired.groupBy(*at).agg(F.max("assignee").alias("wanted"))
    o = stored.groupBy(*at).agg(F.max("assignee").alias("has"))
    action = F.when(F.col("has").isNull(), "create").when(F.col("wanted").isNull(), "resolve").when((F.col("wanted") == "human") & (F.col("has") == "agent"), "promote").otherwise("keep")
    return d.join(o, at, "full").select(*at, action.alias("action"))


def reconcile_blocks(stored: DataFrame, current: DataFrame) -> DataFrame:
    """page, start_offset, content_hash, match: each current block is `exact` (same place and hash as a stored one), `moved` (the n-th of
    its hash that isn't exact pairs with the n-th stored one left over) or `new`. Both: page, start_offset, content_hash."""
    at = ["page", "start_offset", "content_hash"]
    s, c = stored.select(*at).distinct(), current.select(*at).distinct()
    exact = c.join(s, at, "left_semi")

    def numbered(df: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        return df.join(exact, at, "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("page", "content_hash").orderBy("start_offset")))

    rest = numbered(c).join(numbered(s).select("page", "content_hash", "n", F.lit(True).alias("paired")), ["page", "content_hash", "n"], "left")
    return exact.select(*at, F.lit("exact").alias("match")).unionByName(rest.select(*at, F.when(F.col("paired"), "moved").otherwise("new").alias("match")))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that right doesn't cancel one by one."""
    return left.exceptAll(right)


def set_differences(left: DataFrame, right: DataFrame, item: str, sides: tuple[str, str] = ("left", "right")) -> DataFrame:
    """item, side: what only one of two sets has, and which one. Null items are none."""
    a, b = (x.select(item).where(F.col(item).isNotNull()).distinct() for x in (left, right))
    return a.join(b, item, "left_anti").withColumn("side", F.lit(sides[0])).unionByName(b.join(a, item, "left_anti").withColumn("side", F.lit(sides[1])))


def undocumented(symbols: DataFrame, duty: DataFrame) -> DataFrame:
    """Keys of active symbols that no page promises to document."""
    return symbols.where("status = 'active'").select(F.col("key").alias("symbol_key")).distinct().join(duty.select("symbol_key").distinct(), "symbol_key", "left_anti")


def partition_errors(wanted: DataFrame, parts: DataFrame) -> DataFrame:
    """item, error: `missing` from all parts, `duplicate` in several, or `extra`. wanted: item; parts: part, item."""
    n = parts.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    w = wanted.select("item").distinct().withColumn("w", F.lit(True))
    error = F.when(F.col("n").isNull(), "missing").when(F.col("w").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return w.join(n, "item", "full").select("item", error.alias("error")).where("error is not null")


def group_digest(df: DataFrame, by: list[str], order: list[str], text) -> DataFrame:
    """SHA-256 over a group's texts in order. The texts of one group are joined in one task: for groups of bounded size."""
    parts = F.sort_array(F.collect_list(F.struct(*order, text.alias("t"))))
    return df.groupBy(*by).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), ""), 256).alias("digest"))

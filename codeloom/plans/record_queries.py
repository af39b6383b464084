"""Queries of the operators that write, read back, stream, and keep a baseline, over the test tables, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import text as X
from codeloom.functions.keys import normal_key
from codeloom.operators import activity, baseline_ops, graph, impact, ledger, planning, resolve, status, verify
from codeloom.plans.lineage import cut, shared_folder
from codeloom.plans.workspace_queries import _BOOT, _DUTY, _LEDGER, _RAT, _SETS, DIR, EXT, KEY, MOD, T, _active, _bootstrap, _ledger, _page_sets, _role_sql
from codeloom.sources import history, scan, sinks
from codeloom.streaming import watch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _folder(spark) -> str:
    """A new folder in the place that all machines share."""
    return f"{shared_folder(spark)}/codeloom-{uuid.uuid4().hex}"


# ---- what a version control log and a ledger give, written as they come and read back

@query("log_churn", "SELECT path, count(*) AS commits FROM (SELECT DISTINCT f.path, epoch_us(c.recorded_at) // 1000000 AS ts FROM calls c JOIN files f ON f.id = c.file_id) GROUP BY 1")
def log_churn(spark, d):
    return history.churn(_read_log(spark, d))


@query("log_times", "SELECT f.path, min(epoch_us(c.recorded_at) // 1000000) AS first_at, max(epoch_us(c.recorded_at) // 1000000) AS last_at FROM calls c JOIN files f ON f.id = c.file_id GROUP BY 1")
def log_times(spark, d):
    return history.path_times(_read_log(spark, d))


def _read_log(spark, d):
    """A log with a commit for each second in which calls of files were recorded, in as many text files as there are partitions."""
    calls, files = T(spark, d, "calls", "files")
    touched = calls.select(F.col("file_id").alias("id"), F.floor(F.unix_micros("recorded_at") / 1_000_000).alias("ts")).distinct().join(files.select("id", "path"), "id")
    folder = _folder(spark)
    touched.select(F.concat(F.lit("@"), F.col("ts").cast("string"), F.lit("\n\n"), "path").alias("value")).write.text(folder)
    return history.read_name_only_log(spark, folder)


@query("diff_paths", "SELECT DISTINCT f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.status = 'deleted'")
def diff_paths(spark, d):
    symbols, files = T(spark, d, "symbols", "files")
    return history.changed_paths(symbols.where("status = 'deleted'").select(F.col("file_id").alias("id")).join(files.select("id", "path"), "id"))


@query("ledger_rows", f"WITH {_LEDGER} SELECT kind, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM led GROUP BY 1")
def ledger_rows(spark, d):
    """The activity ledger appended to as JSON lines in two goes and read again."""
    folder, rows = _folder(spark), _ledger(spark, d).select("seq", "kind", "tokens")
    for part in (0, 1):
        rows.where(F.pmod("seq", F.lit(2)) == part).write.mode("append").json(folder)
    read = history.read_ledger(spark, folder, "seq long, kind string, tokens long, _corrupt_record string")
    return cut(read).where("_corrupt_record is null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query("walked_files", """
SELECT f.path, octet_length(encode(content)) AS size FROM files f JOIN file_contents c ON c.file_id = f.id
WHERE f.path IN (SELECT path FROM files WHERE id % 20 = 0) AND octet_length(encode(content)) <= 1048576 AND strpos(content, chr(0)) = 0
  AND NOT regexp_matches(f.path, '(^|/)(dist|node_modules|coverage|\\.git)/') AND NOT regexp_matches(lower(f.path), '[.-]min\\.(js|css)$') AND strpos(regexp_extract(f.path, '[^/]*$'), '.') > 0""")
def walked_files(spark, d):
    """Files written out as a repository and walked again: what the walk keeps, with their sizes. The stated set of ids divisible by 20 is written."""
    files, contents = T(spark, d, "files", "file_contents")
    f = files.where("id % 20 = 0").select(F.col("id").alias("file_id"), "path").join(contents, "file_id")
    folder = _folder(spark)

    def write(rows):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        for r in rows:
            where.create_dir(f"{base}/{r['path'].rpartition('/')[0]}", recursive=True)
            with where.open_output_stream(f"{base}/{r['path']}") as out:
                out.write(r["content"].encode("utf-8"))

    f.foreachPartition(write)
    return scan.walk(spark, folder).select("path", "size")


# ---- an index run over the contents, with a grammar that came and one that was built anew

_GRAMMARS = [("ts", "typescript", "1", "1"), ("py", "python", "1", "2"), ("go", None, None, "1"), ("rs", "rust", "1", "1"), ("java", "java", "1", "1"), ("js", "javascript", "1", "1")]
_LANGS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items())
_PLAN = f"""
WITH g AS (SELECT * FROM (VALUES {', '.join(f"('{e}', '{ {'go': 'go'}.get(e, g) }', {'true' if e in ('py', 'go') else 'false'})" for e, g, _, _ in _GRAMMARS)}) v(ext, grammar, changed)),
now AS (SELECT f.path, sha256(replace(content, chr(13) || chr(10), chr(10))) AS h, sha256(content) AS raw, CASE WHEN strpos(content, chr(13) || chr(10)) = 0 THEN sha256(replace(content, chr(10), chr(13) || chr(10))) END AS crlf,
  CASE {EXT.format('f.path')} {_LANGS} ELSE {EXT.format('f.path')} END AS now_lang FROM file_contents c JOIN files f ON f.id = c.file_id WHERE f.id % 20 <> 0),
j AS (SELECT coalesce(f.path, n.path) AS path, f.id, f.content_hash, f.lang, f.status = 'active' AND f.id % 7 <> 0 AS live, f.id IN (SELECT file_id FROM symbols WHERE status = 'active') AS told, n.*, n.path IS NOT NULL AS there
  FROM (SELECT * FROM files WHERE id % 11 <> 0) f FULL JOIN now n ON n.path = f.path),
plan AS (SELECT j.path, CASE WHEN id IS NULL THEN 'add' WHEN NOT there THEN CASE WHEN live THEN 'delete' ELSE 'gone' END
  WHEN content_hash = h THEN CASE WHEN live AND ((grammar IS NOT NULL AND NOT told) OR coalesce(changed, false) OR lang IS DISTINCT FROM now_lang) THEN 'reprocess' ELSE 'unchanged' END
  WHEN content_hash = raw OR content_hash = crlf THEN 'migrate' ELSE 'update' END AS action, coalesce(there AND NOT live, false) AS reactivated FROM j LEFT JOIN g ON g.ext = {EXT.format('j.path')})"""


def _plan(spark, d):
    files, contents, symbols = T(spark, d, "files", "file_contents", "symbols")
    # the record lacks some files and has others as deleted; the walk lacks the stated set of ids divisible by 20
    record = files.where("id % 11 <> 0").withColumn("status", F.when(F.col("id") % 7 == 0, "deleted").otherwise(F.col("status")))
    found = contents.join(files.where("id % 20 <> 0").select(F.col("id").alias("file_id"), "path"), "file_id").withColumn("lang", P.language(F.col("path")))
    old = spark.createDataFrame([(e, g, a) for e, g, a, _ in _GRAMMARS if g], "ext string, grammar string, artifact string")
    new = spark.createDataFrame([(e, g or e, a) for e, g, _, a in _GRAMMARS], "ext string, grammar string, artifact string")
    return ledger.file_plan(record, found, symbols, ledger.grammar_changes(old, new))


@query("file_plan", _PLAN + " SELECT * FROM plan")
def file_plan(spark, d):
    return _plan(spark, d)


@query("index_counters", _PLAN + """, before AS (SELECT DISTINCT key FROM symbols WHERE status = 'deleted'), after AS (SELECT DISTINCT key FROM symbols WHERE status = 'active')
SELECT count(*) FILTER (action NOT IN ('delete', 'gone')) AS scanned, count(*) FILTER (action = 'add') AS added, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'reprocess') AS reprocessed_grammar,
  count(*) FILTER (action IN ('unchanged', 'migrate')) AS unchanged, count(*) FILTER (reactivated) AS reactivated,
  (SELECT count(*) FROM file_contents WHERE octet_length(encode(content)) <= 1048576 AND strpos(substr(content, 1, 8192), chr(0)) > 0) AS skipped_binary, (SELECT count(*) FROM file_contents WHERE octet_length(encode(content)) > 1048576) AS skipped_too_large,
  (SELECT count(*) FROM after WHERE key NOT IN (SELECT key FROM before)) AS symbols_added, (SELECT count(*) FROM before WHERE key NOT IN (SELECT key FROM after)) AS symbols_deleted FROM plan""")
def index_counters(spark, d):
    files, contents, symbols = T(spark, d, "files", "file_contents", "symbols")
    return ledger.index_counters(_plan(spark, d), scan.scan_reasons(files, contents), symbols.where("status = 'deleted'"), symbols.where("status = 'active'"))


# ---- versions, merges and exports

@query("published_symbols", "SELECT key, status, content_hash FROM symbols WHERE status = 'active'")
def published_symbols(spark, d):
    """Active symbols published in two versions, the second merged into the first, and read as the current one."""
    rows, folder = T(spark, d, "symbols").where("status = 'active'").select("key", "status", "content_hash"), _folder(spark)
    sinks.update(spark, folder, lambda old: rows.where("length(key) % 2 = 0").withColumn("content_hash", F.lit("old")))
    sinks.update(spark, folder, lambda old: sinks.upsert(old, rows, ["key"]))
    return spark.read.parquet(sinks.current(spark, folder))


@query("ignored_duplicates", "SELECT name, min(kind) AS kind FROM symbols WHERE status = 'active' GROUP BY 1 UNION ALL SELECT name, min(kind) FROM symbols WHERE name NOT IN (SELECT name FROM symbols WHERE status = 'active') GROUP BY 1")
def ignored_duplicates(spark, d):
    """A table rebuilt from active symbols, to which deleted ones are added where their name isn't there."""
    s = T(spark, d, "symbols")
    old = sinks.rebuild(s.where("status = 'active'").select("name", "kind"), ["name"])
    return sinks.insert_or_ignore(old, sinks.rebuild(s.where("status = 'deleted'").select("name", "kind"), ["name"]), ["name"])


@query("exported_pages", "SELECT DISTINCT replace(wiki_path, '/', '--') AS name FROM documents WHERE wiki_path IS NOT NULL AND text IS NOT NULL")
def exported_pages(spark, d):
    pages, folder = T(spark, d, "documents").where("wiki_path is not null and text is not null").select("wiki_path", "text"), _folder(spark)
    sinks.export_pages(pages, folder)
    return spark.read.schema("name string, text string").json(folder).select("name").distinct()


# ---- baseline

@query("baseline_moved", f"WITH {_BOOT} SELECT wiki_path, symbol_key, max(hash) AS hash FROM (SELECT wiki_path, CASE WHEN length(symbol_key) % 3 = 0 THEN wiki_path || '#moved' ELSE symbol_key END AS symbol_key, hash FROM boot) GROUP BY 1, 2")
def baseline_moved(spark, d):
    """Entries moved to another key; several that meet in one keep one, the one of the greatest hash."""
    b = cut(_bootstrap(spark, d))
    moves = b.where("length(symbol_key) % 3 = 0").select("wiki_path", "symbol_key", F.concat("wiki_path", F.lit("#moved")).alias("moved_to"))
    return baseline_ops.move(b, moves).select("wiki_path", "symbol_key", "hash")


@query("baseline_removed", f"WITH {_BOOT} SELECT * FROM boot WHERE length(symbol_key) % 2 = 1")
def baseline_removed(spark, d):
    b = cut(_bootstrap(spark, d))
    return baseline_ops.remove(b, b.where("length(symbol_key) % 2 = 0"))


@query("baseline_relocated", f"WITH {_BOOT} SELECT CASE WHEN length(wiki_path) % 2 = 0 THEN 'new/' || wiki_path ELSE wiki_path END AS wiki_path, symbol_key, hash, extraction, provenance FROM boot")
def baseline_relocated(spark, d):
    b = cut(_bootstrap(spark, d))
    return baseline_ops.relocate(b, b.where("length(wiki_path) % 2 = 0").select("wiki_path", F.concat(F.lit("new/"), "wiki_path").alias("new_path")).distinct())


@query("baseline_advanced", f"WITH {_BOOT} SELECT wiki_path, symbol_key, CASE WHEN length(symbol_key) % 2 = 0 THEN hash ELSE 'old' END AS hash, extraction, provenance FROM boot")
def baseline_advanced(spark, d):
    """A baseline with old hashes, of which every entry with a state that allows it comes to the present hash."""
    b = cut(_bootstrap(spark, d))
    state = F.when(F.length("symbol_key") % 2 == 1, "moved").when(F.length("symbol_key") % 4 == 0, "clean").otherwise("changed")
    return baseline_ops.advance(b.withColumn("hash", F.lit("old")), b.select("wiki_path", "symbol_key", state.alias("state")), _active(spark, d))


@query("baseline_issues", f"""
WITH e AS (SELECT CASE WHEN id % 3 = 0 THEN '../' || name WHEN id % 3 = 1 THEN ' ' ELSE name END AS wiki_path, key AS symbol_key, content_hash AS hash, 'ts-v1' AS extraction, status AS provenance FROM symbol_snapshots)
SELECT wiki_path, symbol_key, 'no_path' AS issue FROM e WHERE trim(wiki_path) = '' UNION ALL SELECT wiki_path, symbol_key, 'path_leaves_root' FROM e WHERE starts_with(wiki_path, '../')
UNION ALL SELECT wiki_path, symbol_key, 'malformed_key' FROM e WHERE NOT regexp_matches(symbol_key, '^[^#]+#.+$') UNION ALL SELECT wiki_path, symbol_key, 'malformed_hash' FROM e WHERE NOT regexp_full_match(hash, '[0-9a-f]{{64}}')
UNION ALL SELECT wiki_path, symbol_key, 'unknown_extraction' FROM e WHERE (CASE {' '.join(f"WHEN {EXT.format("split_part(symbol_key, '#', 1)")} = '{k}' THEN '{v}'" for k, v in P.EXTRACTIONS.items())} END) IS DISTINCT FROM 'ts-v1'
UNION ALL SELECT wiki_path, symbol_key, 'unknown_provenance' FROM e WHERE provenance NOT IN ('accepted', 'inferred')
UNION ALL SELECT wiki_path, symbol_key, 'duplicate' FROM e GROUP BY 1, 2 HAVING count(*) > 1""")
def baseline_issues(spark, d):
    """Checks of entries made of rows as delivered, which spell keys, hashes and states in several ways."""
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("../"), "name")).when(F.col("id") % 3 == 1, " ").otherwise(F.col("name"))
    s = T(spark, d, "symbol_snapshots")
    return baseline_ops.validate(s.select(path.alias("wiki_path"), F.col("key").alias("symbol_key"), F.col("content_hash").alias("hash"), F.lit("ts-v1").alias("extraction"), F.col("status").alias("provenance")))


@query("entries_without_anchor", f"""
WITH {_DUTY}, every AS (SELECT wiki_path, {KEY.format('u')} AS symbol_key FROM (SELECT wiki_path, unnest(page_anchors) AS u FROM extracted_anchors UNION ALL SELECT wiki_path, unnest(x.symbol_keys) FROM (SELECT wiki_path, unnest(section_anchors) AS x FROM extracted_anchors)) WHERE u IS NOT NULL),
e AS (SELECT DISTINCT wiki_path, symbol_key FROM every JOIN (SELECT key, max(content_hash) AS h FROM symbols WHERE status = 'active' GROUP BY 1) a ON a.key = symbol_key WHERE symbol_key <> '')
SELECT wiki_path, 'baseline_entry_without_anchor' AS issue, symbol_key AS detail FROM e WHERE NOT EXISTS (SELECT 1 FROM duty d WHERE d.wiki_path = e.wiki_path AND d.symbol_key = e.symbol_key)""")
def entries_without_anchor(spark, d):
    """A baseline made of all extractions of pages, against the anchors of the last ones."""
    anchors = T(spark, d, "extracted_anchors")
    baseline = cut(baseline_ops.bootstrap(ledger.anchored_keys(anchors), _active(spark, d)))
    return verify.baseline_problems(baseline, ledger.obligations(anchors))


@query("working_tree", f"""
WITH {_BOOT}, changed AS (SELECT path FROM files WHERE size IS NULL), fresh AS (SELECT key, h FROM act WHERE length(key) % 5 <> 0)
SELECT boot.wiki_path, boot.symbol_key, CASE WHEN fresh.key IS NULL THEN 'deleted' WHEN length(boot.symbol_key) % 2 = 0 THEN 'changed' ELSE 'clean' END AS event
FROM boot LEFT JOIN fresh ON fresh.key = boot.symbol_key WHERE split_part(boot.symbol_key, '#', 1) IN (SELECT path FROM changed)""")
def working_tree(spark, d):
    """What anchors to files of unrecorded size would become: some symbols are gone from the working tree, others have another hash."""
    b = cut(_bootstrap(spark, d))
    k = F.length("key")
    fresh = _active(spark, d).where(k % 5 != 0).select("key", F.when(k % 2 == 0, "new").otherwise(F.col("content_hash")).alias("content_hash"))
    return impact.working_tree_preview(b, b, fresh, T(spark, d, "files").where("size is null").select("path"))


# ---- blocks, hubs, clusters

@query("block_matches", f"""
WITH b AS (SELECT DISTINCT wiki_path AS page, epoch(recorded_at)::BIGINT AS t, s.anchor_marker_offset AS start_offset, sha256(s.heading_text) AS content_hash FROM (SELECT wiki_path, recorded_at, unnest(section_anchors) AS s FROM extracted_anchors)),
n AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY t DESC) AS age FROM b), c AS (SELECT DISTINCT page, start_offset, content_hash FROM n WHERE age = 1), s AS (SELECT DISTINCT page, start_offset, content_hash FROM n WHERE age = 2),
exact AS (SELECT * FROM c INTERSECT SELECT * FROM s), rc AS (SELECT *, row_number() OVER (PARTITION BY page, content_hash ORDER BY start_offset) AS k FROM (SELECT * FROM c EXCEPT SELECT * FROM exact)), rs AS (SELECT *, row_number() OVER (PARTITION BY page, content_hash ORDER BY start_offset) AS k FROM (SELECT * FROM s EXCEPT SELECT * FROM exact))
SELECT page, start_offset, content_hash, 'exact' AS match FROM exact UNION ALL SELECT rc.page, rc.start_offset, rc.content_hash, CASE WHEN rs.k IS NULL THEN 'new' ELSE 'moved' END FROM rc LEFT JOIN rs USING (page, content_hash, k)""")
def block_matches(spark, d):
    """Sections of each page's last extraction as blocks, against those of the one before."""
    e = T(spark, d, "extracted_anchors").select(F.col("wiki_path").alias("page"), F.floor(F.unix_micros("recorded_at") / 1_000_000).alias("t"), F.explode("section_anchors").alias("s"))
    from pyspark.sql import Window

    b = e.select("page", "t", F.col("s.anchor_marker_offset").alias("start_offset"), F.sha2("s.heading_text", 256).alias("content_hash")).distinct()
    aged = cut(b.withColumn("age", F.dense_rank().over(Window.partitionBy("page").orderBy(F.desc("t")))))
    return ledger.reconcile_blocks(aged.where("age = 2"), aged.where("age = 1"))


@query("altered_sections", """
WITH b AS (SELECT wiki_path, sha256(h) AS content_hash, t FROM (SELECT wiki_path, epoch(recorded_at)::BIGINT AS t, unnest(section_anchors).heading_text AS h FROM extracted_anchors)),
n AS (SELECT *, dense_rank() OVER (PARTITION BY wiki_path ORDER BY t DESC) AS age FROM b)
SELECT wiki_path, 'manual_block_altered' AS issue, content_hash AS detail FROM (SELECT wiki_path, content_hash FROM n WHERE age = 2 EXCEPT ALL SELECT wiki_path, content_hash FROM n WHERE age = 1)""")
def altered_sections(spark, d):
    """Sections of the extraction before that no section of the last one stands for, taken as manual blocks."""
    from pyspark.sql import Window

    e = T(spark, d, "extracted_anchors").select("wiki_path", F.floor(F.unix_micros("recorded_at") / 1_000_000).alias("t"), F.explode("section_anchors").alias("s")).select("wiki_path", "t", F.col("s.heading_text").alias("text"))
    aged = cut(e.withColumn("age", F.dense_rank().over(Window.partitionBy("wiki_path").orderBy(F.desc("t")))))
    now = aged.where("age = 1").groupBy("wiki_path").agg(F.collect_list(F.struct("text")).alias("manual_blocks"))
    return verify.altered_blocks(aged.where("age = 2").select("wiki_path", F.sha2("text", 256).alias("content_hash")), now)


@query("hub_components", f"""
WITH RECURSIVE {_SETS}, few AS (SELECT item FROM s GROUP BY 1 HAVING count(*) <= 3), m AS (SELECT s.* FROM s JOIN few USING (item)), both_ways AS (SELECT a.id AS x, b.id AS y FROM m a JOIN m b USING (item)),
walk AS (SELECT DISTINCT id AS node, id AS seen FROM m UNION SELECT walk.node, both_ways.y FROM walk JOIN both_ways ON both_ways.x = walk.seen)
SELECT node, min(seen) AS component FROM walk GROUP BY 1""")
def hub_components(spark, d):
    """Pages that share a directory that few pages refer to, directly or over others."""
    s = cut(_page_sets(spark, d))
    few = s.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n <= 3").select("item")
    return graph.joined_by_hub(s.join(few, "item", "left_semi").select(F.col("id").alias("node"), F.col("item").alias("hub")))


@query("capped_clusters", f"""
SELECT cluster, id FROM (SELECT {MOD.format('path')} AS cluster, id, row_number() OVER (PARTITION BY {MOD.format('path')} ORDER BY CASE WHEN {_role_sql('path')} = 'product' THEN 0 ELSE 1 END, coalesce(size, 0) DESC, id) AS rn FROM files WHERE status = 'active') WHERE rn <= 6""")
def capped_clusters(spark, d):
    f = T(spark, d, "files").where("status = 'active'")
    m = f.select(resolve.module_of(F.col("path")).alias("cluster"), "id", P.path_role(F.col("path")).alias("kind"), F.coalesce("size", F.lit(0)).alias("weight"))
    return planning.cluster_cap(m).select("cluster", "id")


# ---- texts and rationales

@query("signature_lines", "SELECT id, left(trim(regexp_replace(signature, '\\s+', ' ', 'g'), ' '), 200) AS line FROM symbols WHERE signature IS NOT NULL AND length(signature) <= 200")
def signature_lines(spark, d):
    s = T(spark, d, "symbols").where("signature is not null and length(signature) <= 200")
    return s.select("id", F.trim(F.regexp_replace(X.signature_line(F.col("signature")), r"\s+", " ")).alias("line"))


_EXCERPT = "text"
for _pattern, _with, _flags in (("(?s)```.*?```|~~~.*?~~~", " ", "g"), ("`[^`\\n]*`", " ", "g"), ("(?s)<!--.*?-->", " ", "g"), ("(?m)^#{1,6}\\s+.*$", " ", "g"), ("\\[([^\\]]*)\\]\\(([^)]*)\\)", "\\1", "g"), ("[#>*_`|-]+", " ", "g"), ("\\s+", " ", "g")):
    _EXCERPT = f"regexp_replace({_EXCERPT}, '{_pattern}', '{_with}', '{_flags}')"


@query("page_excerpts", f"SELECT doc_id, substr(trim({_EXCERPT}, ' '), 1, 400) AS excerpt FROM documents WHERE text IS NOT NULL")
def page_excerpts(spark, d):
    return T(spark, d, "documents").where("text is not null").select("doc_id", X.plain_excerpt(F.col("text")).alias("excerpt"))


@query("rationales_in_order", f"""WITH {_RAT}, r AS (SELECT path, line, kind, text FROM rat JOIN files f ON f.id = rat.file_id WHERE kind <> '' AND length(text) >= 20 AND f.status = 'active')
SELECT path, row_number() OVER (PARTITION BY path ORDER BY line, kind, text) AS place, line, kind, text FROM r""")
def rationales_in_order(spark, d):
    """Intent comments beside their file's path, by path and line, with their place in the file."""
    files, contents = T(spark, d, "files", "file_contents")
    return resolve.rationales_of_files(scan.rationales(contents), files)


# ---- streams

@query("streamed_weeks", f"WITH {_LEDGER} SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM led GROUP BY 1")
def streamed_weeks(spark, d):
    """The ledger delivered in four files, taken in by micro-batches that end when nothing is left, each merged into the weeks so far."""
    folder = _folder(spark)
    rows = _ledger(spark, d).select("seq", "ts", "kind", "tokens")
    rows.repartition(4, "seq").write.parquet(f"{folder}/in")

    def take(batch, n: int) -> None:
        sums = activity.weekly(batch, 10_000)
        sinks.write_part(sums, f"{folder}/out", n)

    watch.sync(watch.read_deliveries(spark, f"{folder}/in", rows.schema, 1), take, f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("week").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))


@query("page_set_differences", """
SELECT wiki_path, CASE WHEN r.wiki_path IS NULL THEN 'only present' ELSE 'only recorded' END AS side FROM (SELECT DISTINCT wiki_path FROM doc_pages) r FULL JOIN (SELECT DISTINCT wiki_path FROM documents WHERE wiki_path IS NOT NULL) p USING (wiki_path) WHERE r.wiki_path IS NULL OR p.wiki_path IS NULL""".replace("SELECT wiki_path,", "SELECT coalesce(r.wiki_path, p.wiki_path) AS wiki_path,").replace("USING (wiki_path)", "ON p.wiki_path = r.wiki_path"))
def page_set_differences(spark, d):
    pages, docs = T(spark, d, "doc_pages", "documents")
    return ledger.set_differences(pages.select("wiki_path"), docs.select("wiki_path"), "wiki_path", ("only recorded", "only present"))

"""The queries of the general data problems over the workspace tables, and their SQL."""

from __future__ import annotations

from codeloom.operators.orphans import direct_symbol_orphans, orphan_report, workspace_orphans
from codeloom.operators.snapshots import change_kinds, snapshot_changes
from codeloom.sources.tables import table
from pyspark.sql import functions as F


def p3_found(spark, d):
    return snapshot_changes(table(spark, d, "symbol_snapshots"))


def p3_summary(spark, d):
    return change_kinds(table(spark, d, "symbol_snapshots")).groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n_keys"))


def _orphans(spark, d):
    return workspace_orphans(*(table(spark, d, n) for n in ("files", "symbols", "shared_symbols", "calls", "doc_pages", "extracted_anchors")))


def p4_found(spark, d):
    return direct_symbol_orphans(_orphans(spark, d)).select("ref_table", "ref_month", "symbol_key", "reason")


def p4_report(spark, d):
    return direct_symbol_orphans(_orphans(spark, d)).groupBy("ref_table", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_refs").alias("n_refs"))


def p4_cascade(spark, d):
    return orphan_report(_orphans(spark, d))


QUERIES = {"p3_found": p3_found, "p3_summary": p3_summary, "p4_found": p4_found, "p4_report": p4_report, "p4_cascade": p4_cascade}

_KEY = "regexp_replace(replace(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '\\', '/'), '^(\\./)+', '')"

_P3 = f"""
WITH valid AS (
  SELECT snapshot_no, {_KEY.format("key")} AS key, lower(trim(status)) AS status,
         regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS h,
         row_number() OVER (PARTITION BY snapshot_no, id ORDER BY delivered_at DESC) AS rn
  FROM symbol_snapshots),
present AS (SELECT snapshot_no, key, min(h) AS h FROM valid WHERE rn = 1 AND status = 'active' GROUP BY ALL),
numbers AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT snapshot_no FROM symbol_snapshots)),
now AS (SELECT n.snapshot_no, p.key, p.h FROM numbers n JOIN present p USING (snapshot_no) WHERE n.before IS NOT NULL),
old AS (SELECT n.snapshot_no, p.key, p.h FROM numbers n JOIN present p ON p.snapshot_no = n.before),
found AS (
  SELECT snapshot_no, key,
         CASE WHEN old.h IS NULL THEN 'added' WHEN now.h IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM now FULL JOIN old USING (snapshot_no, key)
  WHERE old.h IS DISTINCT FROM now.h)
"""

_P4 = f"""
WITH RECURSIVE refs AS (
  SELECT 'calls' AS ref_table, recorded_at, resolved_callee_key AS k FROM calls
  UNION ALL SELECT 'page_anchors', recorded_at, unnest(page_anchors) FROM extracted_anchors
  UNION ALL SELECT 'section_anchors', recorded_at, unnest(s.symbol_keys) FROM (SELECT recorded_at, unnest(section_anchors) AS s FROM extracted_anchors)),
r AS (SELECT ref_table, recorded_at, strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS ref_month, {_KEY.format("k")} AS symbol_key FROM refs WHERE k IS NOT NULL),
rows_ AS (SELECT id, key, status, recorded_at, file_id FROM symbols UNION ALL SELECT id, key, status, recorded_at, file_id FROM shared_symbols),
known AS (
  SELECT key AS symbol_key, bool_or(status = 'active') AS live, min(recorded_at) FILTER (status = 'active') AS since
  FROM rows_ GROUP BY 1),
cases AS (
  SELECT ref_table, ref_month, r.symbol_key, live,
         CASE WHEN live IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN since > recorded_at THEN 'late' END AS reason
  FROM r LEFT JOIN known USING (symbol_key) WHERE r.symbol_key <> '')
"""

#: references per month and key over all edges of the graph; lost_symbols and lost_pages are the records that the cascade orphans, with their level
_P4_ALL = _P4 + f""",
own AS (
  SELECT strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS ref_month, key, file_id,
         CASE WHEN strpos(regexp_extract(key, '[^#]*$'), '.') > 0 THEN regexp_replace(key, '\\.[^.]*$', '') END AS holder
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY status = 'active' DESC, id DESC) AS rn FROM rows_) WHERE rn = 1),
direct_symbols AS (
  SELECT DISTINCT key FROM own LEFT JOIN files f ON f.id = own.file_id LEFT JOIN known k ON k.symbol_key = own.holder
  WHERE (own.file_id IS NOT NULL AND coalesce(f.status, '') <> 'active') OR (holder IS NOT NULL AND NOT coalesce(k.live, false))),
falling AS (
  SELECT key, 0 AS level FROM direct_symbols
  UNION SELECT own.key, falling.level + 1 FROM own JOIN falling ON own.holder = falling.key WHERE falling.level < 50),
lost_symbols AS (SELECT key, min(level) AS level FROM falling GROUP BY 1),
lost_pages AS (SELECT DISTINCT doc_page_id FROM extracted_anchors WHERE doc_page_id IS NOT NULL AND doc_page_id NOT IN (SELECT id FROM doc_pages)),
callers AS (SELECT strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS ref_month, {_KEY.format("caller_key")} AS symbol_key FROM calls WHERE caller_key IS NOT NULL),
edges AS (
  SELECT ref_table, 'symbols' AS parent_table, ref_month, symbol_key AS k, min(reason) AS reason, count(*) AS n FROM cases GROUP BY 1, 2, 3, 4
  UNION ALL SELECT 'callers', 'symbols', ref_month, symbol_key, min(CASE WHEN live IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' END), count(*) FROM callers LEFT JOIN known USING (symbol_key) WHERE symbol_key <> '' GROUP BY 1, 2, 3, 4
  UNION ALL SELECT 'symbols', 'symbols', ref_month, key || ' ' || holder, CASE WHEN live IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' END, 1 FROM own LEFT JOIN known k ON k.symbol_key = own.holder WHERE holder IS NOT NULL
  UNION ALL SELECT 'symbols', 'files', ref_month, key, CASE WHEN f.id IS NULL THEN 'missing' WHEN f.status <> 'active' THEN 'deleted' END, 1 FROM own LEFT JOIN files f ON f.id = own.file_id WHERE own.file_id IS NOT NULL
  UNION ALL SELECT 'extracted_anchors', 'doc_pages', strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m'), doc_page_id::VARCHAR, CASE WHEN max(p.id) IS NULL THEN 'missing' END, count(*) FROM extracted_anchors e LEFT JOIN doc_pages p ON p.id = e.doc_page_id WHERE doc_page_id IS NOT NULL GROUP BY 1, 2, 3, 4),
held AS (
  SELECT 'page_anchors' AS ref_table, doc_page_id, recorded_at, unnest(page_anchors) AS k FROM extracted_anchors
  UNION ALL SELECT 'section_anchors', doc_page_id, recorded_at, unnest(s.symbol_keys) FROM (SELECT doc_page_id, recorded_at, unnest(section_anchors) AS s FROM extracted_anchors)),
all_found AS (
  SELECT ref_table, parent_table, ref_month, CASE WHEN reason IS NULL THEN 'inherited' ELSE 'direct' END AS kind, coalesce(reason, 'orphaned') AS reason, n,
         level + 1 AS above
  FROM edges LEFT JOIN lost_symbols l ON parent_table = 'symbols' AND l.key = CASE WHEN ref_table = 'symbols' THEN split_part(k, ' ', 2) ELSE k END
  WHERE reason IS NOT NULL OR level IS NOT NULL
  UNION ALL SELECT ref_table, 'extracted_anchors', strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m'), 'inherited', 'orphaned', count(*), 1
  FROM held JOIN lost_pages USING (doc_page_id) WHERE {_KEY.format("k")} <> '' GROUP BY ref_table, doc_page_id, 3)
"""

ORACLE = {
    "p3_found": _P3 + "SELECT snapshot_no, key, change_kind FROM found",
    "p3_summary": _P3 + "SELECT snapshot_no, change_kind, count(*) AS n_keys FROM found GROUP BY ALL",
    "p4_found": _P4 + "SELECT DISTINCT ref_table, ref_month, symbol_key, reason FROM cases WHERE reason IS NOT NULL",
    "p4_report": _P4_ALL + "SELECT ref_table, ref_month, reason, count(*) AS n_keys, sum(n)::BIGINT AS n_refs FROM all_found WHERE kind = 'direct' AND parent_table = 'symbols' AND ref_table IN ('calls', 'page_anchors', 'section_anchors') GROUP BY ALL",
    "p4_cascade": _P4_ALL + "SELECT ref_table, parent_table, ref_month, kind, reason, count(*) AS n_keys, sum(n)::BIGINT AS n_refs, count(above) AS n_above, max(coalesce(above, 0)) AS max_level FROM all_found GROUP BY ALL",
}

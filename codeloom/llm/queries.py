"""Queries of the training-data operators over the workspace tables, and their SQL."""

from __future__ import annotations

from codeloom.llm.docpairs import doc_pairs, documented_symbols, linked_counts
from codeloom.llm.encoding import encode_corpus, token_counts
from codeloom.llm.handwritten import LEAST_LINE, PROSE, VENDOR_DIRS, unwritten_files
from codeloom.llm.lookalike import group_members, lookalike_pairs, same_form
from codeloom.llm.mixing import mix_sources
from codeloom.llm.splitting import oversized_items, split_oversized
from codeloom.sources.tables import table
from pyspark.sql import functions as F


def p1_found(spark, d):
    return documented_symbols(*(table(spark, d, n) for n in ("files", "file_contents", "symbols")))


def p1_pairs(spark, d):
    return doc_pairs(*(table(spark, d, n) for n in ("files", "file_contents", "symbols")))


def p1_linked(spark, d):
    return linked_counts(*(table(spark, d, n) for n in ("files", "file_contents", "symbols")))


def p2_found(spark, d):
    return oversized_items(table(spark, d, "file_contents"), table(spark, d, "symbols"))


def p2_pieces(spark, d):
    return split_oversized(table(spark, d, "file_contents"), table(spark, d, "symbols"))


def p5_reasons(spark, d):
    return unwritten_files(*(table(spark, d, n) for n in ("files", "file_contents", "vendor_catalog")))


def p5_found(spark, d):
    return p5_reasons(spark, d).select("file_id")


def p5_copies(spark, d):
    return p5_reasons(spark, d).where("containment is not null").select("file_id", F.round("containment", 6).alias("containment"))


def p6_ids(spark, d):
    return encode_corpus(table(spark, d, "documents"), "text", ["doc_id"])


def p6_counts(spark, d):
    counts = token_counts(table(spark, d, "documents"), "text", ["source"])
    return counts.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def p7_mix(spark, d):
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).rows


def p7_report(spark, d):
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


def p8_found(spark, d):
    return lookalike_pairs(table(spark, d, "documents"))


def p8_groups(spark, d):
    return group_members(table(spark, d, "documents"))


def p8_forms(spark, d):
    return same_form(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "form")


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p1_linked": p1_linked, "p2_found": p2_found, "p2_pieces": p2_pieces, "p5_found": p5_found, "p5_reasons": p5_reasons, "p5_copies": p5_copies, "p6_ids": p6_ids, "p6_counts": p6_counts, "p7_mix": p7_mix, "p7_report": p7_report, "p8_found": p8_found, "p8_groups": p8_groups, "p8_forms": p8_forms}
#: a symbol's own text by line feed, without its last line end
_P2 = """
WITH big AS (SELECT file_id, content, string_split(content, chr(10)) AS lines FROM file_contents WHERE octet_length(encode(content)) > 6000),
own AS (
  SELECT s.id, regexp_replace(array_to_string(lines[s.start_line:s.end_line], chr(10)), '\\r$', '') AS t
  FROM symbols s JOIN big USING (file_id) WHERE s.status = 'active')
SELECT 'file' AS item_kind, file_id AS item_id FROM big
UNION ALL SELECT 'symbol', id FROM own WHERE octet_length(encode(t)) > 6000
"""
#: exact containment over all lines, of every file in every reference
_VENDOR = " OR ".join(f"list_contains(dirs, '{x}')" for x in VENDOR_DIRS)
_PROSE = ", ".join(f"'{x}'" for x in PROSE)
_LINES = f"""list_distinct(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(translate(x, chr(13) || chr(9) || chr(65279), '   '), ' ')), lambda x: length(x) >= {LEAST_LINE}))"""
_P5 = f"""
WITH f AS (
  SELECT c.file_id, array_to_string(string_split(path, '/')[1:2], '/') AS repo, string_split(lower(replace(path, '\\', '/')), '/') AS dirs, {_LINES} AS ls
  FROM file_contents c JOIN files f ON f.id = c.file_id
  WHERE lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\\.([^.]*)$', 1)) NOT IN ({_PROSE})),
refs AS (SELECT row_number() OVER () AS ref, home, ls FROM (SELECT '' AS home, {_LINES} AS ls FROM vendor_catalog UNION ALL SELECT repo, ls FROM f WHERE {_VENDOR})),
held AS (SELECT ref, home, unnest(ls) AS l FROM refs),
met AS (SELECT file_id, ref, len(any_value(ls)) AS n, count(*) AS shared FROM (SELECT file_id, repo, ls, unnest(ls) AS l FROM f) JOIN held USING (l) WHERE home <> repo GROUP BY file_id, ref)
SELECT file_id, round(max(shared / n), 6) AS containment FROM met WHERE shared >= 0.6 * n - 1e-9 GROUP BY file_id
"""
ORACLE: dict[str, str] = {"p2_found": _P2, "p5_copies": _P5}

"""The queries of the workspace operators over the test tables, each with SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import text as X
from codeloom.functions.keys import normal_key
from codeloom.functions.markdown import parse_pages
from codeloom.operators import activity, baseline_ops, flows, graph, impact, ledger, planning, resolve, search, status, verify
from codeloom.operators.snapshots import valid_rows
from codeloom.plans.lineage import cut
from codeloom.sources import scan, sinks
from codeloom.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def T(spark, d, *names):
    out = [table(spark, d, n) for n in names]
    return out[0] if len(out) == 1 else out


KEY = "regexp_replace(replace(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '\\', '/'), '^(\\./)+', '')"
BASE = "regexp_extract({0}, '[^/]*$')"
DIR = "CASE WHEN strpos({0}, '/') > 0 THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"
EXT = "lower(regexp_extract(regexp_extract({0}, '[^/]*$'), '^.+\\.([^.]*)$', 1))"
MOD = "array_to_string(string_split({0}, '/')[1:2], '/')"


def _role_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{_q(P.any_pattern_regex(P.ROLE_PATTERNS[r]))}') THEN '{r}'" for r in ("fixture", "test", "tooling", "docs")) + " ELSE 'product' END"


# ---- scans, paths and predicates

_DENIED = (
    f"CASE WHEN regexp_matches(path, '{_q(P.any_pattern_regex(P.DEFAULT_IGNORES))}') THEN 'ignored' WHEN strpos({BASE.format('path')}, '.') = 0 THEN 'no extension' "
    f"WHEN {EXT.format('path')} IN ({', '.join(repr(x) for x in P.DENIED_EXTENSIONS)}) THEN 'extension' WHEN lower({BASE.format('path')}) IN ({', '.join(repr(x) for x in P.DENIED_NAMES)}) THEN 'name' "
    f"WHEN lower(path) LIKE '%.min.js' OR lower(path) LIKE '%.min.css' THEN 'minified' END"
)


@query("scan_verdicts", f"""
SELECT verdict, count(*) AS n FROM (
  SELECT coalesce({_DENIED}, CASE WHEN octet_length(encode(content)) > 1048576 THEN 'too large' WHEN strpos(substr(content, 1, 8192), chr(0)) > 0 THEN 'binary' END, 'kept') AS verdict
  FROM file_contents JOIN files ON files.id = file_id) GROUP BY 1""")
def scan_verdicts(spark, d):
    files, contents = T(spark, d, "files", "file_contents")
    return scan.scan_reasons(files, contents).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("path_languages", f"""
SELECT coalesce(CASE {' '.join(f"WHEN {EXT.format('path')} = '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items())} END, {EXT.format('path')}) AS lang, count(*) AS n FROM files GROUP BY 1""")
def path_languages(spark, d):
    return T(spark, d, "files").groupBy(P.language(F.col("path")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query("path_roles", f"SELECT id, {_role_sql('path')} AS role, regexp_matches(path, '{_q(P.NARROW_TEST)}') AS narrow_test FROM files")
def path_roles(spark, d):
    return T(spark, d, "files").select("id", P.path_role(F.col("path")).alias("role"), P.narrow_test(F.col("path")).alias("narrow_test"))


_SIGNALS = ["**/internal/**", "/packages/*/src/", "*.pb.*", "test/*.rs"]


@query("ignore_patterns", f"""SELECT id FROM files WHERE regexp_matches(path, '{_q(P.any_pattern_regex(_SIGNALS))}') AND NOT regexp_matches(path, '{_q(P.glob_regex("**/*.toml"))}')""")
def ignore_patterns(spark, d):
    return T(spark, d, "files").where(P.matches_any(F.col("path"), [*_SIGNALS, "!**/*.toml"])).select("id")


@query("active_tiers", f"SELECT CASE WHEN lower(trim(lang)) IN ({', '.join(repr(x) for x in sorted(set(P.LANGUAGES.values())))}) THEN 'anchored' ELSE 'prose' END AS tier, count(*) AS n FROM files WHERE status = 'active' GROUP BY 1")
def active_tiers(spark, d):
    return T(spark, d, "files").where("status = 'active'").groupBy(P.tier(F.lower(F.trim("lang"))).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("key_parts", f"""
SELECT id, CASE WHEN strpos(key, '#') > 1 THEN string_split(key, '#')[1] END AS path, CASE WHEN strpos(key, '#') > 1 THEN substr(key, strpos(key, '#') + 1) END AS name,
  CASE {' '.join(f"WHEN {EXT.format(chr(34) + 'p' + chr(34))} = '{k}' THEN '{v}'" for k, v in P.EXTRACTIONS.items())} END AS extraction
FROM (SELECT id, key, CASE WHEN strpos(key, '#') > 1 THEN string_split(key, '#')[1] END AS p FROM symbols)""")
def key_parts(spark, d):
    k = F.col("key")
    return T(spark, d, "symbols").select("id", P.key_path(k).alias("path"), P.key_name(k).alias("name"), P.extraction_version(k).alias("extraction"))


@query("generated_headers", """
SELECT file_id FROM (SELECT file_id, lower(array_to_string(string_split(content, chr(10))[1:8], chr(10))) AS head FROM file_contents)
WHERE """ + " OR ".join(f"contains(head, '{m}')" for m in P.GENERATED_MARKS))
def generated_headers(spark, d):
    return T(spark, d, "file_contents").where(P.generated_header(F.col("content"))).select("file_id")


@query("page_groups", """
SELECT wiki_path, CASE WHEN rel = 'quickstart.md' THEN 'Quickstart' WHEN wiki_path LIKE '%.mmd' THEN 'Diagrams'
  WHEN rel LIKE 'topics/%' AND name <> 'index.md' THEN 'Concept topics' WHEN rel LIKE 'flows/%' AND name <> 'index.md' THEN 'Flows'
  WHEN rel LIKE 'auxiliary/%' AND name <> 'index.md' THEN 'Auxiliary areas' WHEN rel LIKE 'architecture/%' THEN 'Indexes & overviews'
  WHEN strpos(rel, '/') = 0 AND rel <> 'tasks.md' THEN 'Implementation reference' WHEN regexp_matches(rel, '^[^/]+/[^/]+\\.md$') THEN 'Implementation reference' ELSE 'Indexes & overviews' END AS page_group,
  CASE WHEN owner = 'human' THEN 'human' ELSE 'agent' END AS assignee
FROM (SELECT wiki_path, owner, rel, regexp_extract(rel, '[^/]*$') AS name FROM (SELECT wiki_path, owner, substr(wiki_path, strpos(wiki_path, '/') + 1) AS rel FROM doc_pages))""")
def page_groups(spark, d):
    return T(spark, d, "doc_pages").select("wiki_path", P.page_group(F.col("wiki_path")).alias("page_group"), P.assignee(F.lit(False), F.col("owner")).alias("assignee"))


# ---- symbols, calls and edges

_EDGES = f"""
edges AS (SELECT DISTINCT f.path AS from_file, to_file FROM (
  SELECT file_id, CASE WHEN strpos(k, '#') > 1 THEN string_split(k, '#')[1] END AS to_file FROM (SELECT file_id, {KEY.format('resolved_callee_key')} AS k FROM calls WHERE resolved_callee_key IS NOT NULL)) c
  JOIN files f ON f.id = c.file_id WHERE to_file IS NOT NULL AND f.path <> to_file)"""
_MEDGES = _EDGES + f""",
known AS (SELECT path, {MOD.format('path')} AS module FROM files WHERE status = 'active'),
medges AS (SELECT DISTINCT a.module AS from_module, b.module AS to_module FROM edges JOIN known a ON a.path = from_file JOIN known b ON b.path = to_file WHERE a.module <> b.module)"""


def _edges(spark, d):
    calls, files = T(spark, d, "calls", "files")
    return resolve.file_edges(calls, files)


def _members(spark, d):
    return T(spark, d, "files").where("status = 'active'").select("path", "size", resolve.module_of(F.col("path")).alias("module"))


def _medges(spark, d):
    return resolve.lift_edges(_edges(spark, d), _members(spark, d))


@query("symbols_of_files", "SELECT s.id, f.path, s.name FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.status = 'active' AND f.status = 'active'")
def symbols_of_files(spark, d):
    s, f = T(spark, d, "symbols", "files")
    return s.where("status = 'active'").select("id", "file_id", "name").join(f.where("status = 'active'").select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path", "name")


@query("resolved_calls", """
WITH named AS (SELECT file_id, name, key FROM symbols WHERE status = 'active' AND kind IN ('function', 'export')),
here AS (SELECT file_id, name, min(key) AS k FROM named GROUP BY 1, 2 HAVING count(*) = 1), anywhere AS (SELECT name, min(key) AS k FROM named GROUP BY 1 HAVING count(*) = 1)
SELECT coalesce(h.k, a.k) AS callee_key, count(*) AS n_calls, count(DISTINCT caller_key) AS n_callers
FROM calls c LEFT JOIN here h ON h.file_id = c.file_id AND h.name = c.callee_name LEFT JOIN anywhere a ON a.name = c.callee_name GROUP BY 1""")
def resolved_calls(spark, d):
    calls, symbols = T(spark, d, "calls", "symbols")
    r = resolve.resolve_calls(calls.select("file_id", "caller_key", "callee_name"), symbols)
    return r.groupBy("callee_key").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("caller_key").alias("n_callers"))


_CE = f"ce AS (SELECT caller_key AS caller, {KEY.format('resolved_callee_key')} AS callee, coalesce(bool_or(confidence = 'extracted'), false) AS extracted FROM calls WHERE resolved_callee_key IS NOT NULL GROUP BY 1, 2)"


@query("top_callees", f"WITH {_CE} SELECT callee, count(*) AS n_callers FROM ce WHERE extracted GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_callees(spark, d):
    return resolve.callee_centrality(T(spark, d, "calls")).orderBy(F.desc("n_callers"), "callee").limit(20)


@query("module_edges", f"WITH {_MEDGES} SELECT * FROM medges")
def module_edges(spark, d):
    return _medges(spark, d)


@query("cross_module_callees", f"""
SELECT DISTINCT k AS callee FROM (SELECT file_id, {KEY.format('resolved_callee_key')} AS k FROM calls WHERE confidence = 'extracted' AND resolved_callee_key IS NOT NULL) c JOIN files f ON f.id = c.file_id
WHERE strpos(k, '#') > 1 AND {MOD.format("string_split(k, '#')[1]")} <> {MOD.format('f.path')}""")
def cross_module_callees(spark, d):
    calls, files = T(spark, d, "calls", "files")
    return resolve.cross_module_callees(calls, files)


@query("importers_of_stale_files", f"WITH {_EDGES} SELECT DISTINCT from_file AS path FROM edges WHERE to_file IN (SELECT path FROM files JOIN file_contents c ON c.file_id = files.id WHERE size <> octet_length(encode(content)))")
def importers_of_stale_files(spark, d):
    """Files that import one whose content isn't as long as its record says."""
    files, contents = T(spark, d, "files", "file_contents")
    stale = files.join(contents.select(F.col("file_id").alias("id"), F.octet_length("content").alias("now")), "id").where("size <> now").select("path")
    return resolve.direct_importers(_edges(spark, d), stale)


@query("innermost_callers", """
SELECT file_id, line, symbol_key FROM (
  SELECT p.file_id, p.line, s.key AS symbol_key, row_number() OVER (PARTITION BY p.file_id, p.line ORDER BY s.start_line DESC NULLS LAST, s.end_line, s.key) AS rn
  FROM (SELECT DISTINCT file_id, line FROM calls) p LEFT JOIN symbols s ON s.file_id = p.file_id AND s.status = 'active' AND p.line BETWEEN s.start_line AND s.end_line) WHERE rn = 1""")
def innermost_callers(spark, d):
    calls, symbols = T(spark, d, "calls", "symbols")
    return resolve.innermost_symbol(calls.select("file_id", "line").distinct(), symbols)


@query("adjacent_symbols", """
SELECT s.id, min(n.key) AS next_key FROM symbols s LEFT JOIN symbols n ON n.file_id = s.file_id AND n.status = 'active' AND n.start_line = s.end_line + 1 WHERE s.status = 'active' GROUP BY 1""")
def adjacent_symbols(spark, d):
    s = T(spark, d, "symbols")
    return resolve.next_symbol(s.where("status = 'active'").select("id", "file_id", "end_line"), s).select("id", "next_key")


@query("files_without_symbols", "SELECT id, path FROM files WHERE status = 'active' AND id NOT IN (SELECT file_id FROM symbols WHERE status = 'active' AND file_id IS NOT NULL)")
def files_without_symbols(spark, d):
    files, symbols = T(spark, d, "files", "symbols")
    return resolve.files_without_symbols(files, symbols)


@query("revived_keys", "SELECT id FROM symbols WHERE status = 'deleted' AND key IN (SELECT key FROM symbols WHERE status = 'active')")
def revived_keys(spark, d):
    s = T(spark, d, "symbols")
    return s.where("status = 'deleted'").join(s.where("status = 'active'").select("key"), "key", "left_semi").select("id")


@query("first_symbol_of_key", "SELECT key, min(id) AS id FROM symbols GROUP BY 1")
def first_symbol_of_key(spark, d):
    return resolve.latest(T(spark, d, "symbols").select("key", "id"), ["key"], ["id"]).select("key", "id")


@query("test_pairs", f"""
WITH p AS (SELECT path, {_role_sql('path')} = 'test' OR path LIKE '%/test/%' AS is_test, {DIR.format('path')} AS dir, {BASE.format('path')} AS name FROM files WHERE status = 'active'),
t AS (SELECT path, dir, CASE WHEN regexp_matches(name, '\\.(test|spec)\\.[^.]+$') THEN regexp_replace(name, '\\.(test|spec)(\\.[^.]+)$', '\\2') END AS same, regexp_replace(coalesce(CASE WHEN regexp_matches(name, '\\.(test|spec)\\.[^.]+$') THEN regexp_replace(name, '\\.(test|spec)(\\.[^.]+)$', '\\2') END, name), '\\.[^.]+$', '') AS stem FROM p WHERE is_test),
r AS (SELECT path, replace(dir, '/test', '/src') AS dir, name, regexp_replace(name, '\\.[^.]+$', '') AS stem FROM p WHERE NOT is_test),
tt AS (SELECT path, replace(dir, '/test', '/src') AS dir, same, stem FROM t),
e AS (SELECT t.path, min(r.path) AS exact_path FROM tt t JOIN r ON r.dir = t.dir AND r.name = t.same GROUP BY 1),
n AS (SELECT * FROM (SELECT t.path, r.path AS near_path, row_number() OVER (PARTITION BY t.path ORDER BY length(r.stem) DESC, r.stem, r.path) AS rn FROM tt t JOIN r ON r.dir = t.dir AND r.stem <> t.stem AND (starts_with(r.stem, t.stem) OR starts_with(t.stem, r.stem))) WHERE rn = 1)
SELECT t.path, CASE WHEN exact_path IS NOT NULL THEN 'test-paired' WHEN near_path IS NOT NULL THEN 'test-likely' ELSE 'test-orphan' END AS disposition, coalesce(exact_path, near_path) AS product_path
FROM t LEFT JOIN e USING (path) LEFT JOIN n USING (path)""")
def test_pairs(spark, d):
    # here a folder named test mirrors src, so both are laid over each other before pairing
    files = T(spark, d, "files").where("status = 'active'").select(F.col("path").alias("real"))
    role = F.when((P.path_role(F.col("real")) == "test") | F.contains("real", F.lit("/test/")), "test").otherwise("product")
    laid = F.concat_ws("/", F.replace(P.dir_name(F.col("real")), F.lit("/test"), F.lit("/src")), P.base_name(F.col("real")))
    p = files.select("real", role.alias("role"), F.concat_ws("\t", laid, F.lit("")).alias("x"), laid.alias("path"))
    out = resolve.paired_tests(p.select("path", "role", "real"))
    tests = p.where("role = 'test'").select("path", F.col("real").alias("t"))
    products = p.where("role <> 'test'").groupBy(F.col("path").alias("product_path")).agg(F.min("real").alias("r"))
    return out.distinct().join(tests, "path").join(products, "product_path", "left").select(F.col("t").alias("path"), "disposition", F.col("r").alias("product_path"))


_SETS = f"""s AS (SELECT DISTINCT wiki_path AS id, {MOD.format('k')} || '|' || {DIR.format("string_split(k, '#')[1]")} AS item
  FROM (SELECT wiki_path, {KEY.format('u')} AS k FROM (SELECT wiki_path, unnest(page_anchors) AS u FROM extracted_anchors UNION ALL SELECT wiki_path, unnest(x.symbol_keys) FROM (SELECT wiki_path, unnest(section_anchors) AS x FROM extracted_anchors)) WHERE u IS NOT NULL) WHERE strpos(k, '#') > 1),
w AS (SELECT id, list_sort(list(item)) AS items FROM s GROUP BY 1), c AS (SELECT id, items, min(id) OVER (PARTITION BY items) AS cls FROM w),
r AS (SELECT id, unnest(items) AS item, len(items) AS n FROM c WHERE id = cls),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM r a JOIN r b ON a.item = b.item AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) / least(a.n, b.n) >= 0.5)"""


def _page_sets(spark, d):
    """The directories that each page refers to, by page and section anchors."""
    anchors = T(spark, d, "extracted_anchors")
    raw = anchors.select("wiki_path", F.explode("page_anchors").alias("raw")).unionByName(anchors.select("wiki_path", F.explode("section_anchors").alias("s")).select("wiki_path", F.explode("s.symbol_keys").alias("raw")))
    k = F.col("k")
    s = raw.select(F.col("wiki_path").alias("id"), normal_key(F.col("raw")).alias("k")).where("instr(k, '#') > 1")
    return s.select("id", F.concat_ws("|", resolve.module_of(k), P.dir_name(P.key_path(k))).alias("item")).distinct()


@query("page_overlaps", f"WITH {_SETS} SELECT a, b, shared FROM pairs")
def page_overlaps(spark, d):
    return resolve.overlap_pairs(_page_sets(spark, d)).select("a", "b", "shared")


@query("page_overlap_links", f"""WITH {_SETS}, size AS (SELECT cls, count(*) AS size FROM c GROUP BY 1), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
others AS (SELECT a AS cls, sum(size) AS others FROM links JOIN size ON size.cls = links.b GROUP BY 1)
SELECT id, cls, (size - 1 + coalesce(others, 0))::BIGINT AS n_links FROM c JOIN size USING (cls) LEFT JOIN others USING (cls)""")
def page_overlap_links(spark, d):
    return resolve.overlap_links(_page_sets(spark, d))


_IMP = " UNION ALL ".join(
    f"SELECT DISTINCT file_id, path, '{fam}' AS family, '{before}' || unnest(regexp_extract_all(content, '{_q(P_)}', 1)) AS specifier FROM src WHERE family = '{fam}'"
    for fam, patterns in resolve.IMPORTS.items() for P_, before in patterns
)
_SRC = f"""src AS (SELECT file_id, path, content, CASE {' '.join(f"WHEN {EXT.format('path')} = '{k}' THEN '{v}'" for k, v in resolve.FAMILY.items())} END AS family FROM file_contents JOIN files ON files.id = file_id)"""


@query("import_statements", f"WITH {_SRC} SELECT family, specifier, count(DISTINCT file_id) AS n_files FROM ({_IMP}) GROUP BY 1, 2")
def import_statements(spark, d):
    files, contents = T(spark, d, "files", "file_contents")
    return resolve.imports(files, contents).groupBy("family", "specifier").agg(F.count_distinct("file_id").alias("n_files"))


#: relative and root imports by the candidates' rules, written for SQL: a place is a file, or with a slash at its end a directory
_ENDINGS = ", ".join(f"'{x}'" for x in ("", *resolve.SCRIPT_ENDINGS))
_NORMAL = "regexp_replace(regexp_replace({0}, '/\\./', '/', 'g'), '^\\./', '')"
@query("resolved_imports", f"""
WITH RECURSIVE {_SRC}, found AS (SELECT DISTINCT path, family, specifier, {DIR.format('path')} AS here, {MOD.format('path')} AS repo FROM ({_IMP})),
parts AS (SELECT *, len(regexp_extract(specifier, '^\\.*')) AS dots, regexp_replace(regexp_replace(specifier, '^\\.+', ''), '\\.', '/', 'g') AS tail, string_split(specifier, '::') AS segs, string_split(specifier, '.') AS names,
  CASE WHEN regexp_extract(path, '([^/]*)\\.rs$', 1) IN ('mod', 'lib', 'main') THEN here ELSE here || '/' || regexp_extract(path, '([^/]*)\\.rs$', 1) END AS own FROM found),
relative AS (  -- `.` and `..` segments of scripts' paths, one after the other
  SELECT path, specifier, string_split(here, '/') AS done, string_split(specifier, '/') AS todo FROM parts WHERE family = 'js' AND starts_with(specifier, '.')
  UNION ALL SELECT path, specifier, CASE WHEN todo[1] IN ('.', '') THEN done WHEN todo[1] = '..' THEN done[1:len(done) - 1] ELSE list_append(done, todo[1]) END, todo[2:] FROM relative WHERE len(todo) > 0),
js AS (SELECT path, specifier, array_to_string(done, '/') AS base FROM relative WHERE len(todo) = 0),
roots AS (
  SELECT path, specifier, segs, CASE segs[1] WHEN 'crate' THEN [coalesce(nullif(regexp_extract(path, '^(.*?(^|/)src)(/|$)', 1), ''), repo || '/src'), repo || '/src', repo] WHEN 'self' THEN [own] WHEN 'super' THEN [array_to_string(string_split(own, '/')[1:len(string_split(own, '/')) - len(list_filter(segs, lambda x: x = 'super'))], '/')] END AS rs
  FROM parts WHERE family = 'rs'),
rust AS (SELECT path, specifier, rs, list_filter(segs, lambda x: x NOT IN ('crate', 'self', 'super')) AS rest FROM roots WHERE rs IS NOT NULL),
tried AS (
  SELECT path, specifier, (e - 1) * 3 AS pos, base || ([{_ENDINGS}])[e] AS place FROM js, range(1, {len(resolve.SCRIPT_ENDINGS) + 2}) t(e)
  UNION ALL SELECT path, specifier, 1, regexp_replace(base, '\\.js$', '.ts') FROM js WHERE base LIKE '%.js' UNION ALL SELECT path, specifier, 2, regexp_replace(base, '\\.jsx?$', '.tsx') FROM js WHERE base LIKE '%.js' OR base LIKE '%.jsx'
  UNION ALL SELECT path, specifier, 1, regexp_replace(base, '\\.([mc])js$', '.\\1ts') FROM js WHERE base LIKE '%.mjs' OR base LIKE '%.cjs'
  UNION ALL SELECT path, specifier, pos, trim(b || '/' || tail, '/') || e FROM (
    SELECT path, specifier, tail, CASE WHEN dots > 0 THEN array_to_string(string_split(here, '/')[1:len(string_split(here, '/')) - dots + 1], '/') ELSE repo END AS b FROM parts WHERE family = 'py') , (VALUES (0, '.py'), (1, '/__init__.py')) v(pos, e)
  UNION ALL SELECT path, specifier, pos, repo || '/src/' || tail || e FROM parts, (VALUES (2, '.py'), (3, '/__init__.py')) v(pos, e) WHERE family = 'py' AND dots = 0
  UNION ALL SELECT path, specifier, r * 1000 + k * 2 + v.pos, rs[r + 1] || '/' || array_to_string(rest[1:len(rest) - k], '/') || e FROM rust, range(0, 3) a(r), range(0, 20) b(k), (VALUES (0, '.rs'), (1, '/mod.rs')) v(pos, e) WHERE r < len(rs) AND k < greatest(len(rest), 1)
  UNION ALL SELECT path, specifier, r * 1000 + k, repo || root || '/' || array_to_string(names[1:len(names) - k], '/') || '/' FROM parts, (VALUES (0, '/src/main/java'), (1, '/src'), (2, '')) v(r, root), range(0, 20) b(k) WHERE family = 'java' AND k < len(names)),
known AS (SELECT path AS to_file FROM files WHERE status = 'active'),
places AS (SELECT to_file AS place, to_file FROM known UNION ALL SELECT {DIR.format('to_file')} || '/', to_file FROM known WHERE regexp_matches(to_file, '\\.(go|java)$')),
best AS (SELECT path, specifier, arg_min(place, pos) AS place FROM tried WHERE place IN (SELECT place FROM places) GROUP BY 1, 2)
SELECT path AS from_file, to_file, specifier FROM best JOIN places USING (place) WHERE path <> to_file""")
def resolved_imports(spark, d):
    files, contents = T(spark, d, "files", "file_contents")
    texts = contents.join(files.where("status = 'active'").select(F.col("id").alias("file_id"), "path"), "file_id")
    return resolve.resolve_imports(resolve.imports(files, contents), files, resolve.module_of(F.col("path")), resolve.workspace_packages(texts), resolve.go_modules(texts))


# ---- graph

#: the symbol that most call, which is the hot one, and the one of no shared module whose number of callers is nearest six
_START = "SELECT callee FROM (SELECT callee FROM ce WHERE callee NOT LIKE 'shared/%' GROUP BY 1 ORDER BY abs(count(*) - 6), callee LIMIT 1) UNION SELECT callee FROM (SELECT callee FROM ce GROUP BY 1 ORDER BY count(*) DESC, callee LIMIT 1)"


def _starts(edges):
    n = edges.groupBy("callee").agg(F.count(F.lit(1)).alias("n"))
    few = n.where(~F.col("callee").startswith("shared/")).orderBy(F.abs(F.col("n") - 6), "callee").limit(1)
    return [r["callee"] for r in few.unionByName(n.orderBy(F.desc("n"), "callee").limit(1)).select("callee").distinct().collect()]  # two rows


#: breadth-first search in the reference's order and with its limits: at most 200 callers within 5 levels. A level's new callers are taken in the order of
#: the callee they were found by, then by name, until there are 200; truncated says that this or the depth ended it
@query("blast_radius", f"""
WITH RECURSIVE {_CE}, start AS ({_START}),
walk AS (
  SELECT callee AS start, [callee] AS seen, [callee] AS frontier, []::STRUCT(caller VARCHAR, depth INT, extracted BOOLEAN)[] AS found, 0 AS depth, false AS cut FROM start
  UNION ALL
  SELECT start, list_concat(seen, fresh), list_transform(news, lambda x: x.caller), list_concat(found, news), depth + 1, len(found) + len(news) >= 200
  FROM (
    SELECT *, list_transform(news, lambda x: x.caller) AS fresh FROM (
      SELECT w.start, w.seen, w.found, w.depth,
             (SELECT coalesce(list({{'caller': caller, 'depth': w.depth + 1, 'extracted': extracted}} ORDER BY pos, caller), []) FROM (
                SELECT caller, pos, extracted, row_number() OVER (ORDER BY pos, caller) AS rn FROM (
                  SELECT ce.caller, min(list_position(w.frontier, ce.callee)) AS pos, arg_min(ce.extracted, list_position(w.frontier, ce.callee)) AS extracted
                  FROM ce WHERE list_contains(w.frontier, ce.callee) AND NOT list_contains(w.seen, ce.caller) GROUP BY 1)) WHERE rn <= 200 - len(w.found)) AS news
      FROM walk w WHERE w.depth < 5 AND len(w.frontier) > 0 AND NOT w.cut))),
last AS (SELECT start, found, cut OR (depth = 5 AND len(frontier) > 0) AS truncated FROM walk QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth DESC) = 1)
SELECT start, f.caller AS caller, f.depth AS depth, f.extracted AS extracted, f.depth = 1 AS direct, truncated FROM (SELECT start, unnest(found) AS f, truncated FROM last)""")
def blast_radius(spark, d):
    edges = cut(resolve.call_edges(T(spark, d, "calls")))
    found = [graph.blast_radius(edges, s).select(F.lit(s).alias("start"), "*") for s in _starts(edges)]
    return reduce(DataFrame.unionByName, found) if found else graph.blast_radius(edges, "").select(F.lit("").alias("start"), "*")


@query("reach_of_shared", f"""
WITH RECURSIVE {_CE}, walk AS (SELECT DISTINCT callee AS node, 0 AS depth FROM ce WHERE callee LIKE 'shared/%' UNION SELECT ce.caller, walk.depth + 1 FROM walk JOIN ce ON ce.callee = walk.node WHERE walk.depth < 2)
SELECT depth, count(*) AS n FROM (SELECT node, min(depth)::INT AS depth FROM walk GROUP BY 1) GROUP BY 1""")
def reach_of_shared(spark, d):
    edges = resolve.call_edges(T(spark, d, "calls"))
    roots = edges.where(F.col("callee").startswith("shared/")).select(F.col("callee").alias("node"))
    return graph.reach(edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), roots, 2).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("affected_pages", f"""
WITH {_CE}, start AS ({_START}), hit AS (SELECT caller AS k FROM ce JOIN start USING (callee) UNION SELECT callee FROM start),
a AS (SELECT wiki_path, unnest(page_anchors) AS u FROM extracted_anchors UNION ALL SELECT wiki_path, unnest(s.symbol_keys) FROM (SELECT wiki_path, unnest(section_anchors) AS s FROM extracted_anchors))
SELECT DISTINCT wiki_path, {KEY.format('u')} AS symbol_key FROM a WHERE u IS NOT NULL AND {KEY.format('u')} IN (SELECT k FROM hit)""")
def affected_pages(spark, d):
    calls, anchors = T(spark, d, "calls", "extracted_anchors")
    edges = cut(resolve.call_edges(calls))
    start = spark.createDataFrame([(s,) for s in _starts(edges)], "callee string")
    hit = edges.join(F.broadcast(start), "callee", "left_semi").select(F.col("caller").alias("symbol_key")).unionByName(start.withColumnRenamed("callee", "symbol_key")).distinct()
    return impact.affected_pages(hit, ledger.anchored_keys(anchors))


_WEIGHTED = f"""{_MEDGES}, wedges AS (SELECT from_module AS src, to_module AS dst, count(*) AS weight FROM (SELECT a.module AS from_module, b.module AS to_module FROM edges JOIN known a ON a.path = from_file JOIN known b ON b.path = to_file WHERE a.module <> b.module) GROUP BY 1, 2),
strong AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM wedges) WHERE rn <= 2)"""


def _module_weights(spark, d):
    e, m = _edges(spark, d), _members(spark, d)
    a = m.select(F.col("path").alias("from_file"), F.col("module").alias("src"))
    b = m.select(F.col("path").alias("to_file"), F.col("module").alias("dst"))
    return e.join(a, "from_file").join(b, "to_file").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def _strong(spark, d):
    return graph.strongest_edges(_module_weights(spark, d), 2)


@query("module_components", f"""
WITH RECURSIVE {_WEIGHTED}, both_ways AS (SELECT src, dst FROM wedges UNION SELECT dst, src FROM wedges),
walk AS (SELECT src AS node, src AS seen FROM both_ways UNION SELECT walk.node, b.dst FROM walk JOIN both_ways b ON b.src = walk.seen)
SELECT node, min(seen) AS component FROM walk GROUP BY 1""")
def module_components(spark, d):
    return graph.components(_module_weights(spark, d).select("src", "dst"))


@query("file_communities")
def file_communities(spark, d):
    return graph.communities(_edges(spark, d).select(F.col("from_file").alias("src"), F.col("to_file").alias("dst")))


@query("partition_agreement")
def partition_agreement(spark, d):
    return graph.partition_agreement(_members(spark, d).select("module", "path"), file_communities(spark, d))


@query("directory_agreement", f"""
WITH {_MEDGES}, found AS (SELECT path AS node, regexp_extract({DIR.format('path')}, '[^/]*$') AS community FROM known),
n AS (SELECT module, community, count(*) AS n FROM known JOIN found ON node = path GROUP BY 1, 2),
plural AS (SELECT community, arg_min(module, (-n, module)) AS plurality FROM n GROUP BY 1),
size AS (SELECT module, count(DISTINCT path) AS n_files FROM known GROUP BY 1),
top AS (SELECT module, arg_min(community, (-n, community)) AS dominant_community, max(n) AS most FROM n GROUP BY 1)
SELECT module, dominant_community, coalesce(most, -1) / n_files AS dominant_share, coalesce(disagreements, 0)::BIGINT AS disagreements
FROM size LEFT JOIN top USING (module) LEFT JOIN (SELECT module, sum(CASE WHEN module <> plurality THEN n ELSE 0 END) AS disagreements FROM n JOIN plural USING (community) GROUP BY 1) USING (module)""")
def directory_agreement(spark, d):
    """The agreement of modules with a partition that SQL can name: the files' last directory."""
    m = _members(spark, d).select("module", "path")
    return graph.partition_agreement(m, m.select(F.col("path").alias("node"), F.substring_index(P.dir_name(F.col("path")), "/", -1).alias("community")))


#: the first 64 walks of each root in the order of their lists, of at most 8 modules: what a depth-first search with that budget visits
_NAMED = "regexp_matches({0}, '" + _q(P.any_pattern_regex(P.ENTRY_PATTERNS)) + "')"
_TESTS = "regexp_matches({0}, '" + _q(P.NARROW_TEST) + "')"
_STORED = "regexp_matches({0}, '" + _q(P.any_pattern_regex(P.STORE_PATTERNS)) + "')"


def _grown(n: int) -> str:
    return f"""w{n} AS (SELECT root, path FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS rn FROM (
  SELECT root, path FROM w{n - 1} UNION ALL SELECT root, list_append(path, dst) FROM w{n - 1} JOIN wedges ON src = path[-1] WHERE len(path) = {n - 1} AND NOT list_contains(path, dst))) WHERE rn <= 64)"""


#: the modules of flows are directories: repositories lead to each other too much to have entries
_WALKS = f"""{_EDGES}, known AS (SELECT path, {DIR.format('path')} AS module FROM files WHERE status = 'active'),
wedges AS (SELECT DISTINCT a.module AS src, b.module AS dst FROM edges JOIN known a ON a.path = from_file JOIN known b ON b.path = to_file WHERE a.module <> b.module),
outside AS (SELECT DISTINCT path FROM ({_IMP}) WHERE specifier <> '' AND NOT regexp_matches(specifier, '^(node:|\\.|/)') AND NOT (regexp_matches(specifier, '^(crate|self|super)(::|$)'))),
signals AS (SELECT module, module NOT IN (SELECT dst FROM wedges) OR bool_or({_NAMED.format('path')}) AS entry, bool_or({_STORED.format('path')}) AS persistence, bool_or(path IN (SELECT path FROM outside)) AS external,
  count(*) FILTER ({_role_sql('path')} = 'product') * 2 >= count(*) AS product, bool_and({_TESTS.format('path')}) AS only_tests FROM known GROUP BY 1),
w1 AS (SELECT module AS root, [module] AS path FROM signals WHERE entry AND NOT only_tests),
{", ".join(_grown(n) for n in range(2, 9))},
found AS (SELECT DISTINCT path FROM w8 WHERE len(path) > 1 AND len(list_filter(path, lambda m: m IN (SELECT module FROM signals WHERE persistence OR external))) > 0)"""
_WALKS = _WALKS.replace("AND len(list_filter(path, lambda m: m IN (SELECT module FROM signals WHERE persistence OR external))) > 0", "AND list_has_any(path, (SELECT coalesce(list(module), []) FROM signals WHERE persistence OR external))")


def _flow_parts(spark, d):
    files, contents = T(spark, d, "files", "file_contents")
    members = files.where("status = 'active'").select(P.dir_name(F.col("path")).alias("module"), "path")
    a, b = (members.select(F.col("path").alias(end), F.col("module").alias(m)) for end, m in (("from_file", "src"), ("to_file", "dst")))
    edges = cut(_edges(spark, d).join(a, "from_file").join(b, "to_file").where("src <> dst").select("src", "dst").distinct())
    said = resolve.imports(files, contents).where("not specifier rlike '^(crate|self|super)(::|$)'").select("path", "specifier")
    return edges, flows.module_signals(members, edges, said)


def _walks(spark, d):
    edges, signals = _flow_parts(spark, d)
    return flows.qualified_walks(edges, signals)


@query("module_signals", f"WITH {_SRC}, {_WALKS.split(chr(10) + "w1 AS")[0].rstrip(",")} SELECT * FROM signals")
def module_signals(spark, d):
    return _flow_parts(spark, d)[1]


@query("module_paths", f"WITH {_SRC}, {_WALKS} SELECT array_to_string(path, ' > ') AS path FROM found")
def module_paths(spark, d):
    return _walks(spark, d).select(F.array_join("path", " > ").alias("path"))


@query("best_module_paths", f"""WITH {_SRC}, {_WALKS} SELECT entry, sink, path FROM (SELECT path[1] AS entry, path[len(path)] AS sink, array_to_string(path, ' > ') AS path, row_number() OVER (PARTITION BY path[1], path[len(path)] ORDER BY len(path) DESC, path) AS rn FROM found) WHERE rn = 1""")
def best_module_paths(spark, d):
    return graph.best_paths(_walks(spark, d)).select("entry", "sink", F.array_join("path", " > ").alias("path"))


_MAXIMAL = "maximal AS (SELECT path FROM found p WHERE NOT EXISTS (SELECT 1 FROM found q WHERE len(q.path) > len(p.path) AND q.path[1:len(p.path)] = p.path))"


@query("maximal_module_paths", f"WITH {_SRC}, {_WALKS}, {_MAXIMAL} SELECT array_to_string(path, ' > ') AS path FROM maximal")
def maximal_module_paths(spark, d):
    return graph.maximal_paths(_walks(spark, d)).select(F.array_join("path", " > ").alias("path"))


@query("path_centrality", f"WITH {_SRC}, {_WALKS} SELECT node, count(*) AS n_paths FROM (SELECT unnest(list_distinct(path)) AS node FROM found) GROUP BY 1")
def path_centrality(spark, d):
    return graph.path_centrality(_walks(spark, d))


@query("ranked_flows", f"""WITH {_SRC}, {_WALKS}, {_MAXIMAL},
best AS (SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY path[1], path[len(path)] ORDER BY len(path) DESC, path) AS rn FROM maximal) WHERE rn = 1),
base AS (SELECT path, regexp_replace(regexp_replace(lower(path[1] || '-to-' || path[len(path)]), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM best),
slugged AS (SELECT path, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) AS n FROM base)),
mine AS (SELECT slug, unnest(path) AS node FROM slugged), walked AS (SELECT array_to_string(path, ' > ') AS walk, unnest(path) AS node FROM found),
central AS (SELECT slug, count(DISTINCT walk) AS centrality FROM mine JOIN walked USING (node) GROUP BY 1),
product AS (SELECT slug, count(*) AS n_product FROM mine JOIN signals ON module = node WHERE product GROUP BY 1)
SELECT row_number() OVER (ORDER BY coalesce(n_product, 0) DESC, centrality DESC, slug) AS rank, slug, array_to_string(path, ' > ') AS path, coalesce(n_product, 0) AS n_product, centrality
FROM slugged JOIN central USING (slug) LEFT JOIN product USING (slug)""")
def ranked_flows(spark, d):
    edges, signals = _flow_parts(spark, d)
    return flows.rank_flows(flows.qualified_walks(edges, signals), signals).withColumn("path", F.array_join("path", " > "))


@query("chosen_flows")
def chosen_flows(spark, d):
    """Flows in rank order that share at most three quarters of their modules with one chosen before."""
    edges, signals = _flow_parts(spark, d)
    candidates = flows.rank_flows(flows.qualified_walks(edges, signals), signals)
    return flows.greedy_apart(candidates.select("rank", F.col("slug").alias("id"), F.col("path").alias("items")))


@query("module_hubs", f"WITH {_MEDGES} SELECT to_module AS dst, count(DISTINCT from_module) AS n FROM medges GROUP BY 1")
def module_hubs(spark, d):
    return graph.in_degree(_medges(spark, d).select(F.col("from_module").alias("src"), F.col("to_module").alias("dst")))


@query("directory_tree", """
SELECT CASE WHEN strpos(child, '/') > 0 THEN regexp_replace(child, '/[^/]*$', '') ELSE '' END AS parent, child, count(*) AS n_files
FROM (SELECT array_to_string(p[1:n], '/') AS child FROM (SELECT string_split(path, '/') AS p, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS n FROM files WHERE status = 'active')) GROUP BY 1, 2""")
def directory_tree(spark, d):
    return graph.directory_tree(T(spark, d, "files").where("status = 'active'").select("path"))


@query("unique_file_ids", """
WITH t AS (SELECT path, n, array_to_string(p[len(p) - n + 1:], '/') AS id FROM (SELECT path, string_split(path, '/') AS p, unnest(generate_series(1, len(string_split(path, '/')))) AS n FROM files)),
alone AS (SELECT id, min(path) AS path, min(n) AS n FROM t GROUP BY 1 HAVING count(*) = 1)
SELECT path, id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n) AS rn FROM alone) WHERE rn = 1""")
def unique_file_ids(spark, d):
    return graph.unique_suffixes(T(spark, d, "files").select("path"), 16)


# ---- change detection

_OLD = f"""
old AS (SELECT key, max(h) AS h FROM (SELECT {KEY.format('key')} AS key, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS h, lower(trim(status)) AS st,
  row_number() OVER (PARTITION BY snapshot_no, id ORDER BY delivered_at DESC) AS rn FROM symbol_snapshots WHERE snapshot_no = 1) WHERE rn = 1 AND st = 'active' GROUP BY 1)"""
_DUTY = f"""
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wiki_path ORDER BY recorded_at DESC) AS rn FROM extracted_anchors) WHERE rn = 1),
raw AS (SELECT wiki_path, owner, false AS manual, unnest(page_anchors) AS u FROM last UNION ALL SELECT wiki_path, owner, s.in_manual_block, unnest(s.symbol_keys) FROM (SELECT wiki_path, owner, unnest(section_anchors) AS s FROM last)),
duty AS (SELECT wiki_path, k AS symbol_key, CASE WHEN bool_or(human) THEN 'human' ELSE 'agent' END AS assignee FROM (SELECT wiki_path, {KEY.format('u')} AS k, coalesce(manual, false) OR coalesce(owner = 'human', false) AS human FROM raw WHERE u IS NOT NULL) WHERE k <> '' GROUP BY 1, 2)"""


def _old_hashes(spark, d):
    v = valid_rows(T(spark, d, "symbol_snapshots").where("snapshot_no = 1")).where("status = 'active'")
    return v.groupBy("key").agg(F.max("content_hash").alias("h"))


def _active(spark, d):
    return T(spark, d, "symbols").where("status = 'active'").groupBy("key").agg(F.max("content_hash").alias("content_hash"), F.max("name").alias("name"))


def _evaluated(spark, d):
    """The pages' obligations stand as accepted in the state of the first snapshot, or inferred where it has no such key."""
    duty = ledger.obligations(T(spark, d, "extracted_anchors"))
    old = _old_hashes(spark, d).select(F.col("key").alias("symbol_key"), F.col("h").alias("hash"))
    b = duty.join(old, "symbol_key").select("wiki_path", "symbol_key", "hash", P.extraction_version(F.col("symbol_key")).alias("extraction"), F.when(F.length("symbol_key") % 7 == 0, "inferred").otherwise("accepted").alias("provenance"))
    return ledger.evaluate_baseline(b, _active(spark, d), duty)


@query("index_plan", f"""
WITH {_OLD}, new AS (SELECT key, max(content_hash) AS h FROM symbols WHERE status = 'active' GROUP BY 1)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN old.key IS NULL THEN 'insert' WHEN new.key IS NULL THEN 'delete' WHEN old.h = new.h THEN 'unchanged' ELSE 'update' END AS action FROM old FULL JOIN new USING (key)) GROUP BY 1""")
def index_plan(spark, d):
    old = _old_hashes(spark, d).select(F.col("key").alias("path"), F.col("h").alias("content_hash"), F.lit("active").alias("status"))
    new = _active(spark, d).select(F.col("key").alias("path"), "content_hash")
    return ledger.plan_counts(ledger.index_plan(old, new))


@query("obligations", f"WITH {_DUTY} SELECT * FROM duty")
def obligations(spark, d):
    return ledger.obligations(T(spark, d, "extracted_anchors"))


_EVAL = f"""{_OLD}, {_DUTY},
base AS (SELECT wiki_path, symbol_key, h AS hash, assignee, CASE WHEN length(symbol_key) % 7 = 0 THEN 'inferred' ELSE 'accepted' END AS provenance FROM duty JOIN old ON old.key = symbol_key),
act AS (SELECT key, max(content_hash) AS h, max(name) AS name FROM symbols WHERE status = 'active' GROUP BY 1), uniq AS (SELECT name FROM act GROUP BY 1 HAVING count(*) = 1),
gone AS (SELECT b.*, substr(symbol_key, strpos(symbol_key, '#') + 1) AS old_name FROM base b WHERE provenance = 'accepted' AND symbol_key NOT IN (SELECT key FROM act)),
pairs AS (SELECT g.wiki_path, g.symbol_key, a.key AS new_key FROM gone g JOIN act a ON a.name = g.old_name AND a.h = g.hash AND {EXT.format("string_split(a.key, '#')[1]")} = {EXT.format("string_split(g.symbol_key, '#')[1]")} JOIN uniq USING (name) WHERE a.key <> g.symbol_key),
moves AS (SELECT p.wiki_path, p.symbol_key, min(p.new_key) AS moved_to FROM pairs p WHERE p.new_key IN (SELECT new_key FROM pairs GROUP BY 1 HAVING count(*) = 1) GROUP BY 1, 2 HAVING count(*) = 1),
ev AS (SELECT wiki_path, symbol_key, CASE WHEN provenance = 'inferred' THEN 'inferred' WHEN a.key IS NULL THEN CASE WHEN moved_to IS NOT NULL THEN 'moved' ELSE 'deleted' END WHEN a.h = b.hash THEN 'clean' ELSE 'changed' END AS state, assignee
  FROM base b LEFT JOIN act a ON a.key = b.symbol_key LEFT JOIN moves USING (wiki_path, symbol_key)
  UNION ALL SELECT wiki_path, symbol_key, 'unbaselined', assignee FROM duty WHERE symbol_key NOT IN (SELECT key FROM old))"""


@query("baseline_states", f"WITH {_EVAL} SELECT wiki_path, symbol_key, state, assignee FROM ev")
def baseline_states(spark, d):
    return _evaluated(spark, d).select("wiki_path", "symbol_key", "state", "assignee")


@query("baseline_counts", f"WITH {_EVAL} SELECT state, count(*) AS n FROM ev GROUP BY 1")
def baseline_counts(spark, d):
    return _evaluated(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("debt_actions", f"""
WITH {_EVAL}, wanted AS (SELECT wiki_path, symbol_key, state AS event, assignee FROM ev WHERE state IN ('changed', 'deleted')),
stored AS (SELECT wiki_path, symbol_key, 'changed' AS event FROM duty WHERE length(symbol_key) % 3 = 0)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN s.wiki_path IS NULL THEN 'create' WHEN w.wiki_path IS NULL THEN 'resolve' WHEN w.assignee = 'human' THEN 'promote' ELSE 'keep' END AS action FROM wanted w FULL JOIN stored s USING (wiki_path, symbol_key, event)) GROUP BY 1""")
def debt_actions(spark, d):
    want = _evaluated(spark, d).where("state in ('changed', 'deleted')").select("wiki_path", "symbol_key", F.col("state").alias("event"), "assignee")
    stored = ledger.obligations(T(spark, d, "extracted_anchors")).where(F.length("symbol_key") % 3 == 0).select("wiki_path", "symbol_key", F.lit("changed").alias("event"), F.lit("agent").alias("assignee"))
    return ledger.debt_sync(want, stored).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("legacy_moves", """
WITH live AS (SELECT * FROM symbols WHERE status = 'active'),
gone AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id DESC) AS rn FROM symbols WHERE status = 'deleted' AND key NOT IN (SELECT key FROM live)) WHERE rn = 1),
bh AS (SELECT content_hash, max_by(key, id) AS hash_key FROM live GROUP BY 1), tw AS (SELECT name, kind, count(*) AS twins FROM live GROUP BY 1, 2),
f AS (SELECT g.key, min_by(l.key, l.id) AS name_key FROM gone g JOIN live l ON l.name = g.name AND l.signature IS NOT DISTINCT FROM g.signature AND l.file_id IS DISTINCT FROM g.file_id WHERE g.content_hash NOT IN (SELECT content_hash FROM live) GROUP BY 1)
SELECT old_key, new_key FROM (SELECT g.key AS old_key, coalesce(hash_key, CASE WHEN coalesce(twins, 0) <= 1 THEN name_key END) AS new_key FROM gone g LEFT JOIN bh ON bh.content_hash = g.content_hash LEFT JOIN f ON f.key = g.key LEFT JOIN tw ON tw.name = g.name AND tw.kind = g.kind)
WHERE new_key IS NOT NULL AND new_key <> old_key""")
def legacy_moves(spark, d):
    s = T(spark, d, "symbols")
    live = s.where("status = 'active'")
    gone = resolve.latest(s.where("status = 'deleted'").join(live.select("key"), "key", "left_anti"), ["key"], [F.desc("id")])
    return ledger.legacy_moves(gone, live)


@query("undocumented_symbols", f"WITH {_DUTY} SELECT DISTINCT key AS symbol_key FROM symbols WHERE status = 'active' AND key NOT IN (SELECT symbol_key FROM duty)")
def undocumented_symbols(spark, d):
    symbols, anchors = T(spark, d, "symbols", "extracted_anchors")
    return ledger.undocumented(symbols, ledger.obligations(anchors))


@query("multiset_difference", "SELECT name, kind FROM symbols WHERE status = 'deleted' EXCEPT ALL SELECT name, kind FROM symbols WHERE status = 'active'")
def multiset_difference(spark, d):
    s = T(spark, d, "symbols")
    return ledger.multiset_difference(s.where("status = 'deleted'").select("name", "kind"), s.where("status = 'active'").select("name", "kind"))


@query("partition_errors", f"""
SELECT coalesce(w.item, p.item) AS item, CASE WHEN p.n IS NULL THEN 'missing' WHEN w.item IS NULL THEN 'extra' WHEN p.n > 1 THEN 'duplicate' END AS error
FROM (SELECT path AS item FROM files WHERE status = 'active') w FULL JOIN (SELECT path AS item, count(*) AS n FROM (SELECT path FROM files WHERE id % 11 <> 0 UNION ALL SELECT path FROM files WHERE id % 13 = 0) GROUP BY 1) p ON p.item = w.item
WHERE p.n IS NULL OR w.item IS NULL OR p.n > 1""")
def partition_errors(spark, d):
    f = T(spark, d, "files")
    parts = f.where("id % 11 <> 0").select(F.lit("a").alias("part"), F.col("path").alias("item")).unionByName(f.where("id % 13 = 0").select(F.lit("b").alias("part"), F.col("path").alias("item")))
    return ledger.partition_errors(f.where("status = 'active'").select(F.col("path").alias("item")), parts)


@query("eol_proofs", "SELECT file_id, CASE WHEN f.content_hash = sha256(replace(content, chr(13) || chr(10), chr(10))) THEN 'same' WHEN f.content_hash = sha256(content) THEN 'raw' WHEN f.content_hash = sha256(replace(replace(content, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10))) THEN 'crlf' ELSE 'changed' END AS proof FROM file_contents JOIN files f ON f.id = file_id")
def eol_proofs(spark, d):
    files, contents = T(spark, d, "files", "file_contents")
    return ledger.eol_migrations(contents, files)


@query("repository_digests", f"""
SELECT repo, sha256(string_agg(line, '' ORDER BY path)) AS digest FROM (SELECT {MOD.format('path')} AS repo, path, path || chr(10) || sha256(replace(content, chr(13) || chr(10), chr(10))) || chr(10) AS line
FROM file_contents JOIN files f ON f.id = file_id WHERE f.status = 'active') GROUP BY 1""")
def repository_digests(spark, d):
    files, contents = T(spark, d, "files", "file_contents")
    return scan.snapshot_digest(files, contents)


def _bootstrap(spark, d):
    return baseline_ops.bootstrap(ledger.obligations(T(spark, d, "extracted_anchors")), _active(spark, d))


_BOOT = f"""{_DUTY}, act AS (SELECT key, max(content_hash) AS h FROM symbols WHERE status = 'active' GROUP BY 1),
boot AS (SELECT wiki_path, symbol_key, h AS hash, CASE {' '.join(f"WHEN {EXT.format(chr(34) + 'p' + chr(34))} = '{k}' THEN '{v}'" for k, v in P.EXTRACTIONS.items())} END AS extraction, 'inferred' AS provenance FROM (SELECT duty.*, h, string_split(symbol_key, '#')[1] AS p FROM duty JOIN act ON act.key = symbol_key))"""


@query("baseline_bootstrap", f"WITH {_BOOT} SELECT * FROM boot")
def baseline_bootstrap(spark, d):
    return _bootstrap(spark, d)


@query("baseline_accepted", f"WITH {_BOOT} SELECT wiki_path, symbol_key, hash, extraction, CASE WHEN length(symbol_key) % 2 = 0 THEN 'accepted' ELSE provenance END AS provenance FROM boot")
def baseline_accepted(spark, d):
    b = _bootstrap(spark, d)
    return baseline_ops.accept(b, b.where(F.length("symbol_key") % 2 == 0).select("wiki_path", "symbol_key"), _active(spark, d))


@query("change_impact", f"""
WITH {_EDGES}, {_DUTY}, changed AS (SELECT path FROM files WHERE id % 20 = 0),
s AS (SELECT DISTINCT key AS name FROM symbols WHERE status = 'active' AND string_split(key, '#')[1] IN (SELECT path FROM changed)),
p AS (SELECT DISTINCT wiki_path AS name FROM duty WHERE symbol_key IN (SELECT name FROM s)), i AS (SELECT DISTINCT from_file AS name FROM edges WHERE to_file IN (SELECT path FROM changed)),
u AS (SELECT 'symbol' AS what, name, 50 AS most FROM s UNION ALL SELECT 'page', name, 20 FROM p UNION ALL SELECT 'importer', name, 25 FROM i)
SELECT what, name, rn, total FROM (SELECT what, name, most, row_number() OVER (PARTITION BY what ORDER BY name) AS rn, count(*) OVER (PARTITION BY what) AS total FROM u) WHERE rn <= most""")
def change_impact(spark, d):
    files, symbols, anchors = T(spark, d, "files", "symbols", "extracted_anchors")
    return impact.change_impact(files.where("id % 20 = 0").select("path"), symbols, ledger.obligations(anchors), _edges(spark, d))


@query("search_records")
def search_records(spark, d):
    return sinks.search_records(parse_pages(_pages(spark, d)), _pages(spark, d))


# ---- status, risk and planning

@query("symbol_kinds", "SELECT kind, status, count(*) AS n FROM symbols GROUP BY 1, 2")
def symbol_kinds(spark, d):
    return status.count_by(T(spark, d, "symbols"), "kind", "status")


@query("top_files", "SELECT path, count(*) AS n_symbols FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.status = 'active' AND f.status = 'active' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_files(spark, d):
    files, symbols = T(spark, d, "files", "symbols")
    return status.top_files(files, symbols)


def _debt(spark, d):
    e = _evaluated(spark, d).where("state in ('changed', 'deleted', 'moved')")
    return e.select(F.sha2(F.concat_ws(" ", "wiki_path", "symbol_key"), 256).alias("id"), "wiki_path", "symbol_key", F.col("state").alias("event"), "assignee", F.length("wiki_path").alias("detected_at"))


_DEBT = f"{_EVAL}, debt AS (SELECT sha256(wiki_path || ' ' || symbol_key) AS id, symbol_key, state AS event, assignee, length(wiki_path) AS detected_at FROM ev WHERE state IN ('changed', 'deleted', 'moved'))"


@query("debt_counts", f"WITH {_DEBT} SELECT count(*) FILTER (event = 'changed') AS changed, count(*) FILTER (event = 'deleted') AS deleted, count(*) FILTER (event = 'moved') AS moved, count(*) FILTER (assignee = 'agent') AS agent, count(*) FILTER (assignee = 'human') AS human, count(*) AS total FROM debt")
def debt_counts(spark, d):
    return status.debt_counts(_debt(spark, d))


@query("debt_by_role", f"""
WITH {_DEBT}, r AS (SELECT symbol_key, {_role_sql('p')} AS role FROM (SELECT symbol_key, string_split(symbol_key, '#')[1] AS p FROM debt) WHERE p IN (SELECT path FROM files WHERE status = 'active')),
top AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY symbol_key) AS rn FROM r)
SELECT role, count(*) AS n, string_agg(symbol_key, ',' ORDER BY symbol_key) FILTER (rn <= 20) AS samples, (SELECT count(*) FROM debt) AS total FROM top GROUP BY 1""")
def debt_by_role(spark, d):
    return status.debt_by_role(_debt(spark, d), T(spark, d, "files"))


@query("fan_in", f"WITH {_EDGES} SELECT to_file AS path, count(DISTINCT from_file) AS fan_in, bool_or(regexp_matches(from_file, '{_q(P.NARROW_TEST)}')) AS covered FROM edges GROUP BY 1")
def fan_in(spark, d):
    return status.fan_in(_edges(spark, d))


@query("risk_ranked", f"""
WITH {_DEBT}, {_EDGES}, fi AS (SELECT to_file AS path, count(DISTINCT from_file) AS n, bool_or(regexp_matches(from_file, '{_q(P.NARROW_TEST)}')) AS covered FROM edges GROUP BY 1),
churn AS (SELECT path, count(*) AS commits FROM calls JOIN files f ON f.id = file_id WHERE confidence IS NULL GROUP BY 1),
j AS (SELECT debt.*, CASE WHEN f.path IS NULL THEN NULL WHEN lower(trim(lang)) IN ({', '.join(repr(x) for x in sorted(set(P.LANGUAGES.values())))}) THEN 'anchored' ELSE 'prose' END AS tier, fi.n, fi.covered, commits
  FROM debt LEFT JOIN files f ON f.path = string_split(symbol_key, '#')[1] AND f.status = 'active' LEFT JOIN fi ON fi.path = string_split(symbol_key, '#')[1] LEFT JOIN churn ON churn.path = string_split(symbol_key, '#')[1])
SELECT id, symbol_key, event, (CASE event WHEN 'moved' THEN 5 ELSE 10 END + CASE WHEN tier = 'anchored' AND NOT coalesce(covered, false) THEN 40 WHEN tier = 'prose' THEN 10 ELSE 0 END
  + CASE WHEN tier = 'anchored' THEN CASE WHEN n >= 11 THEN 20 WHEN n >= 6 THEN 15 WHEN n >= 3 THEN 10 WHEN n >= 1 THEN 5 ELSE 0 END ELSE 0 END
  + CASE WHEN commits >= 10 THEN 15 WHEN commits >= 4 THEN 10 WHEN commits >= 1 THEN 5 ELSE 0 END)::INT AS score, detected_at FROM j""")
def risk_ranked(spark, d):
    calls, files = T(spark, d, "calls", "files")
    churn = calls.where("confidence is null").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy("path").agg(F.count(F.lit(1)).alias("commits"))
    return status.risk_ranked(_debt(spark, d), files, _edges(spark, d), churn)


@query("freshness", "SELECT count(*) AS n_files, count(*) FILTER (c.file_id IS NULL) AS missing, count(*) FILTER (c.file_id IS NOT NULL AND mtime > indexed_at) AS newer FROM files f LEFT JOIN file_contents c ON c.file_id = f.id")
def freshness(spark, d):
    files, contents = T(spark, d, "files", "file_contents")
    present = files.join(contents.select(F.col("file_id").alias("id")), "id", "left_semi").select("path", "mtime")
    return status.freshness(files.select("path", "indexed_at"), present)


@query("page_badges", """
WITH h AS (SELECT p.wiki_path, min(epoch_ms(recorded_at)) AS first_at, max(epoch_ms(recorded_at)) AS last_at FROM doc_pages p JOIN extracted_anchors a USING (wiki_path) GROUP BY 1)
SELECT wiki_path, CASE WHEN first_at >= m - 30 * 86400000::BIGINT THEN 'new' WHEN last_at >= m - 30 * 86400000::BIGINT THEN 'updated' ELSE 'none' END AS badge FROM h, (SELECT max(last_at) AS m FROM h)""")
def page_badges(spark, d):
    pages, anchors = T(spark, d, "doc_pages", "extracted_anchors")
    at = F.floor(F.unix_micros("recorded_at") / 1000)
    h = pages.select("wiki_path").join(anchors.select("wiki_path", at.alias("at")), "wiki_path").groupBy("wiki_path").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return status.badges(h, 30)


@query("page_history", "SELECT wiki_path, epoch_us(min(recorded_at)) AS first_us, epoch_us(max(recorded_at)) AS last_us, count(*) AS n FROM extracted_anchors GROUP BY 1")
def page_history(spark, d):
    h = activity.first_last(T(spark, d, "extracted_anchors"), "wiki_path", "recorded_at")
    return h.select("wiki_path", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "n")


@query("symbol_budget", """
SELECT file_id, key, rn, total FROM (SELECT file_id, key, row_number() OVER (PARTITION BY file_id ORDER BY start_line, key) AS rn, count(*) OVER (PARTITION BY file_id) AS total FROM symbols WHERE status = 'active') WHERE rn <= 5""")
def symbol_budget(spark, d):
    return status.budget_rows(T(spark, d, "symbols").where("status = 'active'").select("file_id", "key", "start_line"), ["file_id"], ["start_line", "key"], 5).select("file_id", "key", "rn", "total")


@query("signature_budget", """
SELECT file_id, id FROM (SELECT file_id, id, sum(length(signature) + 1) OVER (PARTITION BY file_id ORDER BY start_line, id ROWS UNBOUNDED PRECEDING) AS used FROM symbols WHERE status = 'active' AND signature IS NOT NULL) WHERE used <= 300""")
def signature_budget(spark, d):
    s = T(spark, d, "symbols").where("status = 'active' and signature is not null").select("file_id", "id", "start_line", "signature")
    return status.budget_chars(s, ["file_id"], ["start_line", "id"], "signature", 300).select("file_id", "id")


@query("fair_signatures", "SELECT id, substr(signature, 1, greatest(16, 200 // n)::INT) AS signature FROM (SELECT id, signature, count(*) OVER (PARTITION BY file_id) AS n FROM symbols WHERE status = 'active' AND signature IS NOT NULL)")
def fair_signatures(spark, d):
    s = T(spark, d, "symbols").where("status = 'active' and signature is not null").select("id", "file_id", "signature")
    return status.fair_share(s, ["file_id"], "signature", 200, 16).select("id", "signature")


_MODS = f"mods AS (SELECT module, role, n, tier_ FROM (SELECT module, role, n, CASE role WHEN 'product' THEN 0 ELSE 1 END AS tier_, row_number() OVER (PARTITION BY module ORDER BY n DESC, CASE role WHEN 'product' THEN 0 WHEN 'docs' THEN 1 WHEN 'tooling' THEN 2 WHEN 'fixture' THEN 3 ELSE 4 END) AS rn FROM (SELECT module, role, count(*) AS n FROM (SELECT {MOD.format('path')} AS module, {_role_sql('path')} AS role FROM files WHERE status = 'active') GROUP BY 1, 2)) WHERE rn = 1)"


def _roles(spark, d):
    return planning.module_roles(_members(spark, d).withColumn("role", P.path_role(F.col("path"))))


@query("module_roles", f"WITH {_MODS} SELECT module, role, n FROM mods")
def module_roles(spark, d):
    return _roles(spark, d)


_PRIO = f"{_MEDGES}, {_MODS}, prio AS (SELECT m.module, m.role, coalesce(i.n, 0) * 1000 + coalesce(s.n, 0) AS priority, m.tier_ AS tier FROM mods m LEFT JOIN (SELECT to_module AS module, count(DISTINCT from_module) AS n FROM medges GROUP BY 1) i USING (module) LEFT JOIN (SELECT {MOD.format('path')} AS module, count(*) AS n FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.status = 'active' GROUP BY 1) s USING (module))"


def _priority(spark, d):
    s, f = T(spark, d, "symbols", "files")
    n = s.where("status = 'active'").join(f.select(F.col("id").alias("file_id"), resolve.module_of(F.col("path")).alias("module")), "file_id").groupBy("module").agg(F.count(F.lit(1)).alias("n_symbols"))
    return planning.module_priority(_roles(spark, d).join(n, "module", "left"), _medges(spark, d))


@query("module_priority", f"WITH {_PRIO} SELECT module, role, priority, tier FROM prio")
def module_priority(spark, d):
    return _priority(spark, d)


@query("related_modules", f"""
WITH {_PRIO}, b AS (SELECT module, other, bool_or(u) AS uses, bool_or(v) AS used_by FROM (SELECT from_module AS module, to_module AS other, true AS u, false AS v FROM medges UNION ALL SELECT to_module, from_module, false, true FROM medges) GROUP BY 1, 2)
SELECT module, other, uses, used_by, rn FROM (SELECT b.*, row_number() OVER (PARTITION BY b.module ORDER BY p.tier, p.priority DESC, b.other) AS rn FROM b JOIN prio p ON p.module = b.other) WHERE rn <= 3""")
def related_modules(spark, d):
    return planning.related_modules(_medges(spark, d), _priority(spark, d))


@query("module_bytes", f"SELECT {MOD.format('path')} AS module, sum(size)::BIGINT AS bytes, count(*) AS n_files FROM files WHERE status = 'active' GROUP BY 1")
def module_bytes(spark, d):
    return planning.module_bytes(_members(spark, d))


@query("class_methods", """
SELECT file_id, string_split(name, '.')[1] AS class_name, string_agg(DISTINCT substr(name, strpos(name, '.') + 1), ',' ORDER BY substr(name, strpos(name, '.') + 1)) AS methods FROM symbols WHERE status = 'active' AND kind = 'method' AND strpos(name, '.') > 0 GROUP BY 1, 2""")
def class_methods(spark, d):
    return planning.class_methods(T(spark, d, "symbols"))


@query("folder_coverage", f"""
SELECT folder, pages, greatest(0, pages - tests) AS uncovered FROM (SELECT {DIR.format('path')} AS folder, count(*) FILTER (NOT t AND n > 0) AS pages, count(*) FILTER (t) AS tests FROM (
  SELECT path, path LIKE '%/test/%' AS t, (SELECT count(*) FROM symbols s WHERE s.file_id = f.id AND s.status = 'active') AS n FROM files f WHERE status = 'active') GROUP BY 1)""")
def folder_coverage(spark, d):
    f, s = T(spark, d, "files", "symbols")
    n = s.where("status = 'active'").groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    u = f.where("status = 'active'").join(n, "id", "left").select("path", F.when(F.contains("path", F.lit("/test/")), "test-paired").when(F.col("n") > 0, "page").otherwise("inert").alias("disposition"))
    return planning.folder_coverage(u)


#: patterns for which the test tables have cases
_CONCERNS = {"Deployment": ["**/build/**", "**/dist/**", "**/target/**"], "Testing": ["**/test/**", "**/*_test.*"]}


@query("concern_groups", f"""
SELECT concern, {MOD.format('path')} AS module, min(path) AS surface, count(*) AS n_paths FROM (
  {" UNION ALL ".join(f"SELECT '{n}' AS concern, path FROM files WHERE status = 'active' AND regexp_matches(path, '{_q(P.any_pattern_regex(p))}')" for n, p in _CONCERNS.items())}) GROUP BY 1, 2""")
def concern_groups(spark, d):
    return planning.concern_groups(_members(spark, d), {n: P.matches_any(F.col("path"), p) for n, p in _CONCERNS.items()})


@query("chosen_anchors", f"""
WITH RECURSIVE items AS (SELECT {MOD.format('f.path')} AS cluster, s.kind, s.key AS id, s.end_line - s.start_line + 1 AS chars, {_role_sql('f.path')} = 'product' AS is_product FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.status = 'active' AND f.status = 'active'),
turns AS (SELECT *, row_number() OVER (PARTITION BY cluster, kind ORDER BY CASE WHEN is_product THEN 0 ELSE 1 END, chars, id) AS turn FROM items),
ord AS (SELECT cluster, id, chars, is_product, row_number() OVER (PARTITION BY cluster ORDER BY turn, kind, id) AS n FROM turns WHERE chars <= 400),
step AS (
  SELECT DISTINCT cluster, 0::BIGINT AS n, 0 AS chosen, 0::BIGINT AS used, 0 AS products, NULL::VARCHAR AS id FROM ord
  UNION ALL SELECT cluster, n, chosen + ok, used + ok * chars, products + ok * is_product::INT, CASE WHEN ok = 1 THEN id END FROM (
    SELECT o.cluster, o.n, s.chosen, s.used, s.products, o.id, o.chars, o.is_product, CASE WHEN s.chosen < 12 AND s.used + o.chars <= 400 AND (o.is_product OR s.products >= 0.75 * (s.chosen + 1)) THEN 1 ELSE 0 END AS ok
    FROM step s JOIN ord o ON o.cluster = s.cluster AND o.n = s.n + 1))
SELECT cluster, chosen AS position, id FROM step WHERE id IS NOT NULL""")
def chosen_anchors(spark, d):
    """Of each module's symbols those that fit a page's anchors: kinds in turn, products first, within a budget of lines."""
    s, f = T(spark, d, "symbols", "files")
    m = f.where("status = 'active'").select(F.col("id").alias("file_id"), resolve.module_of(F.col("path")).alias("cluster"), (P.path_role(F.col("path")) == "product").alias("is_product"))
    items = s.where("status = 'active'").select("file_id", F.col("key").alias("id"), F.col("kind").alias("group"), (F.col("end_line") - F.col("start_line") + 1).alias("chars"), F.lit(0).alias("weight")).join(m, "file_id").drop("file_id")
    return planning.choose_anchors(items, 12, 400)


@query("round_robin_symbols", "SELECT id FROM (SELECT id, kind, file_id, row_number() OVER (PARTITION BY kind, file_id ORDER BY start_line, id) AS turn FROM symbols WHERE status = 'active') ORDER BY kind, turn, file_id LIMIT 200")
def round_robin_symbols(spark, d):
    return planning.round_robin(T(spark, d, "symbols").where("status = 'active'").select("id", "kind", "file_id", "start_line"), "kind", "file_id", ["start_line", "id"], 200).select("id")


# ---- activity over events

_LEDGER = """led AS (SELECT event_id AS seq, ts, 'u' || user_id AS page, CASE event_type WHEN 'signup' THEN 'package' WHEN 'purchase' THEN 'payment' WHEN 'click' THEN 'resolved' ELSE event_type END AS kind, floor(value)::BIGINT AS tokens, (props::JSON ->> 'k')::BIGINT % 3 AS debt_count FROM events)"""


def _ledger(spark, d):
    kind = F.when(F.col("event_type") == "signup", "package").when(F.col("event_type") == "purchase", "payment").when(F.col("event_type") == "click", "resolved").otherwise(F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("long")
    ts = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())  # stored without a zone, meant as UTC
    return T(spark, d, "events").select(F.col("event_id").alias("seq"), ts.alias("ts"), F.concat(F.lit("u"), "user_id").alias("page"), kind.alias("kind"), F.floor("value").alias("tokens"), (k % 3).alias("debt_count"))


#: one last package over the whole ledger, and both kinds of payment
_PAIRS = f"{_LEDGER}, pairs AS (SELECT * FROM (SELECT *, last_value(CASE WHEN kind = 'package' AND debt_count > 0 THEN ts END IGNORE NULLS) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS package_at FROM led) WHERE kind IN ('payment', 'resolved') AND package_at IS NOT NULL AND ts >= package_at)"


@query("paired_payments", f"WITH {_PAIRS} SELECT seq, page, epoch_us(package_at) AS package_us FROM pairs")
def paired_payments(spark, d):
    return activity.paired_payments(_ledger(spark, d)).select("seq", "page", F.unix_micros("package_at").alias("package_us"))


@query("activity_totals", f"WITH {_LEDGER} SELECT count(*) FILTER (kind = 'package') AS packages, count(*) FILTER (kind = 'payment') AS payments, count(*) FILTER (kind NOT IN ('package', 'payment')) AS others, sum(tokens)::BIGINT AS tokens, floor(sum(tokens) / count(*) FILTER (kind = 'payment') * 10 + 0.5) / 10 AS tokens_per_payment FROM led")
def activity_totals(spark, d):
    return activity.activity_totals(_ledger(spark, d))


@query("activity_weeks", f"WITH {_LEDGER} SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM led GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def activity_weeks(spark, d):
    return activity.weekly(_ledger(spark, d))


@query("hours_to_pay", f"WITH {_PAIRS} SELECT floor(median((epoch_us(ts) - epoch_us(package_at)) / 3600000000) * 10 + 0.5) / 10 AS median_hours, floor(max((epoch_us(ts) - epoch_us(package_at)) / 3600000000) * 10 + 0.5) / 10 AS max_hours, count(*) AS n FROM pairs")
def hours_to_pay(spark, d):
    return activity.hours_to_pay(activity.paired_payments(_ledger(spark, d)))


@query("running_tokens", f"WITH {_LEDGER} SELECT seq, sum(tokens) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM led")
def running_tokens(spark, d):
    return activity.running_total(_ledger(spark, d).select("seq", "tokens"), "seq", "tokens").select("seq", "running")


@query("top_pages", f"WITH {_LEDGER} SELECT page, count(*) FILTER (kind = 'payment') AS writes, sum(tokens)::BIGINT AS tokens FROM led GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def top_pages(spark, d):
    return activity.top_pages(_ledger(spark, d))


@query("recent_events", "SELECT event_id AS seq FROM events ORDER BY 1 DESC LIMIT 10")
def recent_events(spark, d):
    return activity.recent(_ledger(spark, d)).select("seq")


@query("token_accounts", """
WITH u AS (SELECT event_type AS stage, user_id AS task, event_type <> 'error' AS known, floor(value)::BIGINT AS i, (floor(value)::BIGINT) * 2 AS o, CASE WHEN event_id % 97 <> 0 THEN event_id % 10 END AS cost FROM events),
t AS (SELECT stage, task, sum(i) FILTER (known) AS i, sum(o) FILTER (known) AS o, CASE WHEN NOT bool_or(known AND cost IS NULL) THEN sum(cost) FILTER (known) END AS cost, bool_or(NOT known) AS incomplete FROM u GROUP BY 1, 2)
SELECT stage, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(cost)::BIGINT AS cost, bool_or(incomplete) AS incomplete FROM t GROUP BY 1""")
def token_accounts(spark, d):
    e = T(spark, d, "events")
    u = e.select(F.col("event_type").alias("stage"), F.col("user_id").alias("task"), (F.col("event_type") != "error").alias("known"), F.floor("value").alias("input_tokens"), (F.floor("value") * 2).alias("output_tokens"), F.when(F.col("event_id") % 97 != 0, F.col("event_id") % 10).alias("cost"))
    return activity.token_account(u, ["stage"])


@query("circuit_breaker", """
WITH a AS (SELECT event_id, user_id, (event_type = 'error')::INT AS f FROM events),
w AS (SELECT event_id, sum(f) OVER p AS fails, count(*) OVER p AS tried, sum(f) OVER l AS run FROM a WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), l AS (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING))
SELECT event_id FROM w WHERE (run = 3 AND tried >= 3) OR (tried >= 3 AND fails / tried > 0.5)""")
def circuit_breaker(spark, d):
    a = T(spark, d, "events").select("event_id", "user_id", (F.col("event_type") == "error").alias("failed"))
    return activity.breaker(a, "user_id", "event_id").where("open").select("event_id")


# ---- texts

_SPLIT = r"regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"


@query("text_scalars", f"""
SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS digest, ceil(length(text) / 4)::BIGINT AS tokens,
  greatest(512, least(4096, ceil((256 + 16 * (doc_id % 9) + ceil(length(text) / 40)) / 256) * 256))::BIGINT AS budget,
  regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS label FROM documents WHERE text IS NOT NULL""")
def text_scalars(spark, d):
    t = F.col("text")
    docs = T(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", X.content_digest(t).alias("digest"), X.token_estimate(t).alias("tokens"), X.output_budget(F.length(t), F.col("doc_id") % 9, 256, 16, 512, 4096).alias("budget"), X.normal_label(t).alias("label"))


@query("identifier_parts", f"SELECT DISTINCT name, CASE WHEN len(parts) > 1 THEN name || ' ' || array_to_string(parts, ' ') ELSE name END AS parts FROM (SELECT name, list_filter(string_split_regex({_SPLIT.format('name')}, '[_ ]+'), lambda x: x <> '') AS parts FROM (SELECT unnest(string_split(name, '.')) AS name FROM symbols))")
def identifier_parts(spark, d):
    names = T(spark, d, "symbols").select(F.explode(F.split("name", r"\.")).alias("name"))
    return names.select("name", X.split_identifiers(F.col("name")).alias("parts")).distinct()


@query("heading_slugs", "SELECT DISTINCT h, trim(regexp_replace(regexp_replace(lower(h), '[^a-z0-9_\\s-]', '', 'g'), '\\s+', '-', 'g'), '-') AS slug, regexp_replace(regexp_replace(lower(h), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS module_slug FROM (SELECT unnest(section_anchors).heading_text AS h FROM extracted_anchors)")
def heading_slugs(spark, d):
    h = T(spark, d, "extracted_anchors").select(F.explode("section_anchors").alias("s")).select(F.col("s.heading_text").alias("h")).distinct()
    return h.select("h", X.slugify("h").alias("slug"), X.module_slug(F.col("h")).alias("module_slug"))


@query("symbol_snippets", """
SELECT s.id, CASE WHEN start_line <= len(l) THEN array_to_string(l[greatest(start_line - 3, 1):least(end_line + 3, len(l))], chr(10)) END AS snippet FROM symbols s JOIN (SELECT file_id, string_split(content, chr(10)) AS l FROM file_contents) c ON c.file_id = s.file_id WHERE s.status = 'active'""")
def symbol_snippets(spark, d):
    s, c = T(spark, d, "symbols", "file_contents")
    return s.where("status = 'active'").select("id", "file_id", "start_line", "end_line").join(c, "file_id").select("id", X.symbol_snippet(F.col("content"), F.col("start_line"), F.col("end_line")).alias("snippet"))


@query("topic_signals", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{_q(p)}') THEN '{n}' END" for n, p in X.TOPIC_SIGNALS.items()) + "], lambda x: x IS NOT NULL), ',') AS signals FROM documents WHERE text IS NOT NULL")
def topic_signals(spark, d):
    return T(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(X.topic_signals(F.col("text")), ",").alias("signals"))


_RAT = r"""
rat AS (SELECT file_id, lower(regexp_extract(raw, '^[ \t]*(?://+|#+|/\*+|\*)[ \t]*(?i)(why|note|hack|todo|fixme)\b', 1)) AS kind, line,
  regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\s*(///|//!|//|#|/\*\*?)', ''), '\*/\s*$', ''), '^\s*\*+ ?', ''), '\s+', ' ', 'g')), '^(?i)(why|note|hack|todo|fixme)\b[:\s-]*', '') AS text
  FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS raw, unnest(generate_series(1, len(string_split(content, chr(10)))))::INT AS line FROM file_contents))"""


@query("rationales", f"WITH {_RAT} SELECT *, sha256(text) AS content_hash FROM rat WHERE kind <> '' AND length(text) >= 20")
def rationales(spark, d):
    return scan.rationales(T(spark, d, "file_contents"))


@query("rationale_owners", f"""WITH {_RAT}, r AS (SELECT * FROM rat WHERE kind <> '' AND length(text) >= 20)
SELECT file_id, line, kind, text, symbol_key FROM (SELECT r.*, s.key AS symbol_key, row_number() OVER (PARTITION BY r.file_id, r.line ORDER BY s.start_line DESC NULLS LAST, s.end_line, s.key) AS rn
FROM r LEFT JOIN symbols s ON s.file_id = r.file_id AND s.status = 'active' AND r.line BETWEEN s.start_line AND s.end_line) WHERE rn = 1""")
def rationale_owners(spark, d):
    contents, symbols = T(spark, d, "file_contents", "symbols")
    return resolve.innermost_symbol(scan.rationales(contents), symbols).select("file_id", "line", "kind", "text", "symbol_key")


@query("comment_blocks", """
WITH l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS x, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line FROM file_contents),
c AS (SELECT file_id, line, line - row_number() OVER (PARTITION BY file_id ORDER BY line) AS g FROM l WHERE regexp_matches(x, '^\\s*(//|#)'))
SELECT file_id, min(line)::INT AS start_line, max(line)::INT AS end_line FROM c GROUP BY file_id, g""")
def comment_blocks(spark, d):
    lines = T(spark, d, "file_contents").select("file_id", F.posexplode(F.split("content", "\n")).alias("at", "x"))
    return scan.comment_blocks(lines.where(F.col("x").rlike(r"^\s*(//|#)")).select("file_id", (F.col("at") + 1).alias("line")))


def _parsed(spark, d):
    files, contents = T(spark, d, "files", "file_contents")
    f = contents.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").withColumn("lang", P.language(F.col("path")))
    return scan.parse_files(f)


@query("parsed_symbols")
def parsed_symbols(spark, d):
    return _parsed(spark, d).select("path", F.explode("symbols").alias("s")).select("path", "s.*")


@query("reparsed_symbols", """
SELECT s.key, s.name, s.kind, s.start_line, s.end_line FROM symbols s JOIN files f ON f.id = s.file_id JOIN file_contents c ON c.file_id = f.id
WHERE s.status = 'active' AND regexp_matches(f.path, '\\.(ts|py|go|rs)$')""")
def reparsed_symbols(spark, d):
    """The active symbols of TypeScript, Python, Go and Rust that parsing gives again, with the same kind and lines: all of them."""
    at = ["key", "name", "kind", "start_line", "end_line"]
    files, symbols = T(spark, d, "files", "symbols")
    mine = files.where(F.col("path").rlike(r"\.(ts|py|go|rs)$")).select(F.col("id").alias("file_id"))
    known = symbols.where("status = 'active'").join(mine, "file_id", "left_semi").select(*at)
    return known.join(parsed_symbols(spark, d).select(*at), at, "left_semi")


@query("parsed_calls")
def parsed_calls(spark, d):
    return _parsed(spark, d).select(F.explode("calls").alias("c")).select("c.*")


@query("parsed_rationales")
def parsed_rationales(spark, d):
    return _parsed(spark, d).select("path", F.explode("rationales").alias("r")).select("path", "r.*")


# ---- pages and search

def _pages(spark, d):
    docs = T(spark, d, "documents").where("wiki_path is not null and text is not null")
    return resolve.latest(docs.select("wiki_path", "text", "doc_id"), ["wiki_path"], [F.desc("doc_id")])


@query("parsed_pages")
def parsed_pages(spark, d):
    p = parse_pages(_pages(spark, d))
    return p.select("wiki_path", "owner", "title", F.size("page_anchors").alias("n_page_anchors"), F.size("section_anchors").alias("n_section_anchors"), F.size("headings").alias("n_headings"), F.size("links").alias("n_links"), F.size("manual_blocks").alias("n_blocks"), "open_fence", "error")


@query("page_issues")
def page_issues(spark, d):
    symbols, stored = T(spark, d, "symbols", "doc_pages")
    return verify.verify_pages(parse_pages(_pages(spark, d)), symbols, stored)


@query("broken_anchors", f"""
WITH {_DUTY} SELECT DISTINCT wiki_path, symbol_key FROM duty WHERE symbol_key NOT IN (SELECT key FROM symbols WHERE status = 'active')""")
def broken_anchors(spark, d):
    anchors, symbols = T(spark, d, "extracted_anchors", "symbols")
    live = symbols.where("status = 'active'").select(F.col("key").alias("symbol_key")).distinct()
    return ledger.obligations(anchors).join(live, "symbol_key", "left_anti").select("wiki_path", "symbol_key")


@query("missing_pages", "SELECT wiki_path FROM doc_pages WHERE wiki_path NOT IN (SELECT wiki_path FROM documents WHERE wiki_path IS NOT NULL AND text IS NOT NULL)")
def missing_pages(spark, d):
    pages, docs = T(spark, d, "doc_pages", "documents")
    return verify.missing_pages(pages, docs.where("wiki_path is not null and text is not null").select("wiki_path")).select("wiki_path")


_TERMS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(ws) AS term, unnest(generate_series(0, len(ws) - 1)) AS pos, len(ws) AS doc_len FROM w)"""


@query("inverted_index", f"WITH {_TERMS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1")
def inverted_index(spark, d):
    return search.inverted_index(T(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("search_scores", f"""
WITH {_TERMS}, sizes AS (SELECT count(DISTINCT doc_id) AS n, (SELECT avg(len(ws)) FROM w WHERE len(ws) > 0) AS avg_len FROM t),
a AS (SELECT doc_id, doc_len, count(*) AS tf FROM t WHERE term = 'walker' GROUP BY 1, 2), b AS (SELECT doc_id, doc_len, count(*) AS tf FROM t WHERE starts_with(term, 'snap') GROUP BY 1, 2),
h AS (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 FROM b), df AS (SELECT part, count(*) AS df FROM h GROUP BY 1)
SELECT doc_id AS doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
FROM h JOIN df USING (part), sizes WHERE doc_id IN (SELECT doc_id FROM a) AND doc_id IN (SELECT doc_id FROM b) GROUP BY 1""")
def search_scores(spark, d):
    index = search.inverted_index(T(spark, d, "documents"), "doc_id", "text")
    return search.match(index, "walker AND snap*").select("doc", F.round("score", 6).alias("score"))


@query("search_phrase", f"WITH {_TERMS} SELECT DISTINCT a.doc_id AS doc FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'kept' AND b.term = 'next'")
def search_phrase(spark, d):
    return search.match(search.inverted_index(T(spark, d, "documents"), "doc_id", "text"), '"kept next"').select("doc")


@query("search_pages")
def search_pages(spark, d):
    return search.search(_pages(spark, d), "FoldedChannel OR \"sealed channel\"")


@query("quick_find", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(source, '')), 'ledger') OR contains(lower(text), 'ledger') ORDER BY contains(lower(coalesce(source, '')), 'ledger') DESC, doc_id LIMIT 50")
def quick_find(spark, d):
    docs = T(spark, d, "documents").withColumn("title", F.coalesce("source", F.lit("")))
    n = "ledger"
    found = docs.where(F.contains(F.lower("title"), F.lit(n)) | F.contains(F.lower("text"), F.lit(n)))
    return found.orderBy(F.desc(F.contains(F.lower("title"), F.lit(n))), "doc_id").limit(50).select("doc_id")

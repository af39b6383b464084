"""Resolving calls and imports, and edges between files and modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import normal_key, normal_path
from codeloom.functions.paths import dir_name, extension, key_path
from codeloom.plans.lineage import cut

CALLABLE = ("function", "export")


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with callee_key: the only active function or export of that name in the caller's file, else the only one anywhere.

    Stateless: what earlier runs resolved has no say. Candidates are counted per name before they are joined, so a common name
    costs one row. A null callee_name stays unresolved.
    """
    named = symbols.where((F.col("status") == "active") & F.col("kind").isin(*CALLABLE)).select("file_id", "name", "key")
    here = named.groupBy("file_id", F.col("name").alias("callee_name")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("here")).where("n = 1").drop("n")
    anywhere = named.groupBy(F.col("name").alias("callee_name")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("anywhere")).where("n = 1").drop("n")
    return calls.join(here, ["file_id", "callee_name"], "left").join(anywhere, "callee_name", "left").withColumn("callee_key", F.coalesce("here", "anywhere")).drop("here", "anywhere")


def call_edges(calls: DataFrame) -> DataFrame:
    """caller, callee, extracted: distinct resolved calls, and whether any of them was seen in the syntax."""
    c = calls.select(F.col("caller_key").alias("caller"), normal_key(F.col("resolved_callee_key")).alias("callee"), (F.col("confidence") == "extracted").alias("e"))
    return c.where("callee is not null and caller is not null").groupBy("caller", "callee").agg(F.coalesce(F.max("e"), F.lit(False)).alias("extracted"))


def callee_centrality(calls: DataFrame) -> DataFrame:
    """Distinct callers per callee, of resolved calls seen in the syntax."""
    return call_edges(calls).where("extracted").groupBy("callee").agg(F.count(F.lit(1)).alias("n_callers"))


def file_edges(calls: DataFrame, files: DataFrame) -> DataFrame:
    """from_file, to_file: distinct pairs of files of which one calls into the other."""
    src = files.select(F.col("id").alias("file_id"), F.col("path").alias("from_file"))
    c = calls.select("file_id", key_path(normal_key(F.col("resolved_callee_key"))).alias("to_file")).where("to_file is not null").distinct()
    return c.join(src, "file_id").where("from_file <> to_file").select("from_file", "to_file").distinct()


def module_of(path: Column) -> Column:
    """The module of a path: its first two segments."""
    return F.substring_index(path, "/", 2)


def lift_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges of files as edges of modules: distinct, without edges of a module to itself or of files in none. modules: module, path."""
    a = modules.select(F.col("path").alias("from_file"), F.col("module").alias("from_module"))
    b = modules.select(F.col("path").alias("to_file"), F.col("module").alias("to_module"))
    return edges.join(a, "from_file").join(b, "to_file").where("from_module <> to_module").select("from_module", "to_module").distinct()


def cross_module_callees(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Callees that are called from another module, by calls seen in the syntax."""
    src = files.select(F.col("id").alias("file_id"), module_of(F.col("path")).alias("from_module"))
    c = calls.where("confidence = 'extracted'").select("file_id", normal_key(F.col("resolved_callee_key")).alias("callee")).where("callee is not null").distinct()
    return c.join(src, "file_id").where(module_of(key_path(F.col("callee"))) != F.col("from_module")).select("callee").distinct()


def direct_importers(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Files with an edge to a changed file. changed: path."""
    return edges.join(changed.select(F.col("path").alias("to_file")).distinct(), "to_file", "left_semi").select(F.col("from_file").alias("path")).distinct()


#: import statements by family: patterns whose first group is the specifier, and what goes before it (fixed values)
IMPORTS = {
    "js": [(r"""(?m)(?:\bfrom\s*|^\s*import\s*|\brequire\s*\(\s*|\bimport\s*\(\s*)["']([^"'\n]+)["']""", "")],
    "py": [(r"(?m)^[ \t]*from[ \t]+(\.*[\w.]+|\.+)[ \t]+import\b", ""), (r"(?m)^[ \t]*import[ \t]+([\w.]+)", "")],
    "go": [(r'(?m)^import\s+(?:[\w.]+\s+)?"([^"\n]+)"', ""), (r'(?m)^[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"[ \t]*(?://.*)?\r?$', "")],
    "rs": [(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([\w:]*\w)", ""), (r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(\w+)[ \t]*;", "self::")],
    "java": [(r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]*\w)(?:\.\*)?[ \t]*;", "")],
}
FAMILY = {"js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "js", "tsx": "js", "mts": "js", "cts": "js", "py": "py", "go": "go", "rs": "rs", "java": "java"}
#: sources that a compiled ending may stand for, in the order they are tried (fixed values)
COMPILED = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js")
JAVA_ROOTS = ("src/main/java", "src", "")


def _prefixed(before: str):
    return lambda x: F.concat(F.lit(before), x)


def imports(files: DataFrame, contents: DataFrame) -> DataFrame:
    """file_id, path, family, specifier of every import statement, once per file: from, import, require and dynamic imports of scripts, both
    forms of Python, single and grouped ones of Go, use and mod (as self::name) of Rust, plain, static and wildcard ones of Java.

    Patterns over whole texts, so that no text leaves the JVM: a line of a string or comment that reads like an import counts as one.
    """
    family = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])[extension(F.col("path"))]
    src = contents.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").withColumn("family", family).where("family is not null")
    found = F.lit(None).cast("array<string>")
    for name, patterns in IMPORTS.items():
        got = [F.regexp_extract_all("content", F.lit(p), 1) if not before else F.transform(F.regexp_extract_all("content", F.lit(p), 1), _prefixed(before)) for p, before in patterns]
        found = F.when(F.col("family") == name, reduce(lambda a, b: F.concat(a, b), got)).otherwise(found)
    return src.select("file_id", "path", "family", F.explode(F.array_distinct(found)).alias("specifier"))


def _under(base: Column, rest: Column) -> Column:
    return normal_path(F.concat_ws("/", F.when(base != "", base), F.when(rest != "", rest)))


def _script_files(base: Column) -> Column:
    """The files that a script's path may name: itself, its source if it has a compiled ending, and with an ending or as a folder's index."""
    compiled = F.array().cast("array<string>")
    for ending, sources in COMPILED.items():
        stem = F.substring(base, F.lit(1), F.length(base) - len(ending))
        compiled = F.when(F.endswith(base, F.lit(ending)), F.array(*[F.concat(stem, F.lit(x)) for x in sources])).otherwise(compiled)
    return F.concat(F.array(base), compiled, F.array(*[F.concat(base, F.lit(x)) for x in SCRIPT_ENDINGS]))


def _prefixes(parts: Column) -> Column:
    """`a/b/c`, `a/b`, `a` of an array of segments; none for an empty one."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))


def import_candidates(path: Column, family: Column, specifier: Column, repo: Column) -> Column:
    """What a specifier may mean, best first, as an array of paths: a file, or with a slash at its end every file of its language in a directory.

    repo: the root of the file's repository, empty for the tables' own root. Packages that a workspace declares and Go modules go by
    joins of their own, see resolve_imports.
    """
    here = dir_name(path)
    js = F.when(specifier.startswith("."), _script_files(_under(here, specifier)))
    dots = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    tail = F.replace(F.regexp_replace(specifier, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.array_join(F.slice(F.split(here, "/"), F.lit(1), F.greatest(F.size(F.split(here, "/")) - dots + 1, F.lit(0))), "/")
    base = F.when(dots > 0, _under(up, tail)).otherwise(_under(repo, tail))
    in_src = _under(repo, F.concat(F.lit("src/"), tail))
    py = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    py = F.when(dots > 0, py).otherwise(F.concat(py, F.array(F.concat(in_src, F.lit(".py")), F.concat(in_src, F.lit("/__init__.py")))))
    # Rust: the crate's root, which is the src around the file or the repository's, the module's own directory, or one above for each super; the longest run of segments that is a file
    parts = F.split(specifier, "::")
    name = F.regexp_extract(path, r"([^/]*)\.rs$", 1)
    own = F.when(name.isin("mod", "lib", "main"), here).otherwise(_under(here, name))
    supers = F.size(F.filter(parts, lambda x: x == "super"))
    above = F.array_join(F.slice(F.split(own, "/"), F.lit(1), F.greatest(F.size(F.split(own, "/")) - supers, F.lit(0))), "/")
    rest = F.filter(parts, lambda x: ~x.isin("crate", "self", "super"))
    around = F.regexp_extract(path, r"^(.*?(?:^|/)src)(?:/|$)", 1)
    around = F.when(around != "", around).otherwise(_under(repo, F.lit("src")))
    roots = F.when(F.get(parts, F.lit(0)) == "crate", F.array(around, _under(repo, F.lit("src")), repo)).when(F.get(parts, F.lit(0)) == "self", F.array(own)).when(F.get(parts, F.lit(0)) == "super", F.array(above))
    rs = F.flatten(F.transform(roots, lambda r: F.flatten(F.transform(_prefixes(rest), lambda p: F.array(F.concat(_under(r, p), F.lit(".rs")), F.concat(_under(r, p), F.lit("/mod.rs")))))))
    # Java: of each source root the longest run of segments that is a directory with files
    java = F.flatten(F.transform(F.array(*map(F.lit, JAVA_ROOTS)), lambda r: F.transform(_prefixes(F.split(specifier, r"\.")), lambda p: F.concat(_under(_under(repo, r), p), F.lit("/")))))
    return F.when(family == "js", js).when(family == "py", py).when(family == "rs", rs).when(family == "java", java)


def workspace_packages(texts: DataFrame) -> DataFrame:
    """name, dir, main of the packages that a workspace declares: pnpm-workspace.yaml's packages, else `workspaces` of the root's package.json. texts: path, content.

    A pattern is a directory or one with `/*` at its end; others are skipped. Of packages of one name that of the smallest directory counts.
    """
    pnpm = texts.where("path = 'pnpm-workspace.yaml'").select(F.lit(0).alias("rank"), F.explode(F.regexp_extract_all(F.regexp_extract("content", r"(?ms)^packages:\s*\n((?:[ \t]*(?:-.*|#.*)?\r?\n?)*)", 1), F.lit(r"""(?m)^[ \t]*-[ \t]*["']?([^"'\s#]+)"""), 1)).alias("glob"))
    root = texts.where("path = 'package.json'").select(F.get_json_object("content", "$.workspaces").alias("w"))
    listed = root.select(F.lit(1).alias("rank"), F.explode(F.coalesce(F.from_json("w", "array<string>"), F.from_json(F.get_json_object("w", "$.packages"), "array<string>"))).alias("glob"))
    globs = pnpm.unionByName(listed).where(~F.col("glob").rlike(r"^!|[?\[\]{}]|\*.+|[^/]\*")).withColumn("glob", F.regexp_replace("glob", r"^\./|/$", ""))
    first = globs.agg(F.min("rank").alias("rank"))
    globs = globs.join(F.broadcast(first), "rank", "left_semi").select("glob").distinct()  # one row
    manifests = texts.where(F.col("path").endswith("/package.json")).select(dir_name(F.col("path")).alias("dir"), F.get_json_object("content", "$.name").alias("name"), F.get_json_object("content", "$.main").alias("main"))
    keyed = manifests.where("name is not null and name <> ''").withColumn("glob", F.explode(F.array(F.col("dir"), F.concat(dir_name(F.col("dir")), F.lit("/*")))))
    return keyed.join(globs, "glob", "left_semi").groupBy("name").agg(F.min(F.struct("dir", "main")).alias("m")).select("name", "m.dir", "m.main")


def go_modules(texts: DataFrame) -> DataFrame:
    """module, dir of the go.mod files. texts: path, content."""
    return texts.where(F.substring_index("path", "/", -1) == "go.mod").select(F.regexp_extract("content", r"(?m)^module[ \t]+(\S+)", 1).alias("module"), dir_name(F.col("path")).alias("dir")).where("module <> ''")


def resolve_imports(found: DataFrame, files: DataFrame, repo: Column | None = None, packages: DataFrame | None = None, modules: DataFrame | None = None) -> DataFrame:
    """from_file, to_file, specifier: of each import's candidates the first that an active file answers; others are external or unresolved.

    found: path, family, specifier. A directory of Go or Java gives an edge to each of its own files. packages (name, dir, main) and modules (module, dir)
    are what workspace_packages and go_modules give: a specifier belongs to the one whose name is its longest beginning. A file doesn't import itself.
    """
    repo = F.lit("") if repo is None else repo
    known = files.where("status = 'active'").select(F.col("path").alias("to_file")).where("to_file is not null").distinct()
    asked = found.select("path", "family", "specifier").distinct()
    tried = asked.select("path", "specifier", F.posexplode(import_candidates(F.col("path"), F.col("family"), F.col("specifier"), repo)).alias("pos", "place"))
    begins = F.transform(F.sequence(F.lit(1), F.size(F.split("specifier", "/"))), lambda n: F.array_join(F.slice(F.split("specifier", "/"), F.lit(1), n), "/"))
    if packages is not None:
        p = asked.where("family = 'js' and specifier not like '.%'").withColumn("name", F.explode(begins)).join(packages, "name")
        p = p.groupBy("path", "specifier").agg(F.max(F.struct(F.length("name").alias("n"), "name", "dir", "main")).alias("m")).select("path", "specifier", "m.*")
        inner = F.substring("specifier", F.col("n") + 2, F.length("specifier"))
        own = F.concat(F.when(F.col("main").isNotNull(), _script_files(_under(F.col("dir"), F.col("main")))).otherwise(F.array().cast("array<string>")), F.array(*[F.concat("dir", F.lit("/" + x)) for x in ("index.ts", "index.js", "src/index.ts", "src/index.js")]))
        tried = tried.unionByName(p.select("path", "specifier", F.posexplode(F.when(inner == "", own).otherwise(_script_files(_under(F.col("dir"), inner)))).alias("pos", "place")))
    if modules is not None:
        m = asked.where("family = 'go'").withColumn("module", F.explode(begins)).join(modules, "module")
        m = m.groupBy("path", "specifier").agg(F.max(F.struct(F.length("module").alias("n"), "module", "dir")).alias("m")).select("path", "specifier", "m.*")
        tried = tried.unionByName(m.select("path", "specifier", F.lit(0).alias("pos"), F.concat(_under(F.col("dir"), F.substring("specifier", F.col("n") + 2, F.length("specifier"))), F.lit("/")).alias("place")))
    places = known.select(F.col("to_file").alias("place"), "to_file").unionByName(
        known.where(F.col("to_file").rlike(r"\.(?:go|java)$")).select(F.concat(dir_name(F.col("to_file")), F.lit("/")).alias("place"), "to_file")
    )
    there = places.select("place").distinct()  # a directory's files come in only for the candidate that is taken
    best = tried.join(there, "place", "left_semi").groupBy("path", "specifier").agg(F.min(F.struct("pos", "place")).alias("b")).select("path", "specifier", "b.place")
    return best.join(places, "place").select(F.col("path").alias("from_file"), "to_file", "specifier").where("from_file <> to_file")


def innermost_symbol(points: DataFrame, symbols: DataFrame, band: int = 256) -> DataFrame:
    """points (file_id, line, and others) with symbol_key of the innermost active symbol whose lines hold the line.

    Innermost is the one that starts last, then ends first, then has the smaller key. Symbols are dealt into bands of lines and
    joined by file and band, so a long file isn't compared line by symbol. A point in no symbol has a null symbol_key. Equal
    points give one row each.
    """
    s = symbols.where("status = 'active' and start_line <= end_line and file_id is not null").select("file_id", F.col("key").alias("symbol_key"), "start_line", "end_line")
    s = s.withColumn("band", F.explode(F.sequence(F.floor(F.col("start_line") / band), F.floor(F.col("end_line") / band))))
    lines = points.select("file_id", "line").where("file_id is not null and line is not null").distinct().withColumn("band", F.floor(F.col("line") / band))
    hit = lines.join(s, ["file_id", "band"]).where("line between start_line and end_line")
    best = hit.groupBy("file_id", "line").agg(F.min(F.struct((-F.col("start_line")).alias("a"), F.col("end_line").alias("b"), "symbol_key")).alias("m")).select("file_id", "line", F.col("m.symbol_key").alias("symbol_key"))
    return points.join(best, ["file_id", "line"], "left")


def rationales_of_files(rationales: DataFrame, files: DataFrame) -> DataFrame:
    """path, place, line, kind, text of rationales of active files, ordered by path and line; place numbers them within a file. rationales: file_id, line, kind, text."""
    j = rationales.join(files.where("status = 'active'").select(F.col("id").alias("file_id"), "path"), "file_id")
    w = Window.partitionBy("path").orderBy("line", "kind", "text")
    return j.withColumn("place", F.row_number().over(w)).select("path", "place", "line", "kind", "text").orderBy("path", "place")


def next_symbol(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points (file_id, end_line, and others) with next_key: the active symbol that starts on the line after end_line; the smallest key of several."""
    s = symbols.where("status = 'active'").groupBy("file_id", (F.col("start_line") - 1).alias("end_line")).agg(F.min("key").alias("next_key"))
    return points.join(s, ["file_id", "end_line"], "left")


def files_without_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    live = symbols.where("status = 'active' and file_id is not null").select(F.col("file_id").alias("id")).distinct()
    return files.where("status = 'active'").join(live, "id", "left_anti").select("id", "path")


def paired_tests(paths: DataFrame) -> DataFrame:
    """Tests (role test) with the product file they are for: disposition `test-paired` by the name without its infix, `test-likely`
    by the longest product name in the directory of which one is the other's start, else `test-orphan`. paths: path, role."""
    base = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]+$", "")
    p = paths.withColumns({"dir": dir_name(F.col("path")), "name": F.substring_index("path", "/", -1)})
    test = p.where("role = 'test'").withColumn("same", F.when(F.col("name").rlike(r"\.(test|spec)\.[^.]+$"), F.regexp_replace("name", r"\.(test|spec)(\.[^.]+)$", "$2")))
    test = test.withColumn("stem", F.regexp_replace(F.coalesce("same", "name"), r"\.[^.]+$", "")).select("path", "dir", "same", "stem")
    product = p.where("role <> 'test'").select("dir", F.col("name").alias("p_name"), F.col("path").alias("p_path"), base.alias("p_stem"))
    exact = test.join(product.select("dir", F.col("p_name").alias("same"), "p_path"), ["dir", "same"]).select("path", F.col("p_path").alias("exact_path"))
    near = test.join(product, "dir").where((F.col("p_stem") != F.col("stem")) & (F.col("p_stem").startswith(F.col("stem")) | F.col("stem").startswith(F.col("p_stem"))))
    near = near.groupBy("path").agg(F.min(F.struct((-F.length("p_stem")).alias("n"), "p_stem", "p_path")).alias("m")).select("path", F.col("m.p_path").alias("near_path"))
    out = test.select("path").join(exact, "path", "left").join(near, "path", "left")
    kind = F.when(F.col("exact_path").isNotNull(), "test-paired").when(F.col("near_path").isNotNull(), "test-likely").otherwise("test-orphan")
    return out.select("path", kind.alias("disposition"), F.coalesce("exact_path", "near_path").alias("product_path"))


def blocked_pairs(rows: DataFrame, by: str, least: int = 1000) -> DataFrame:
    """a, b: the pairs of ids (a < b) that share a group, once for each group they share. rows: id and the column `by`, distinct.

    A group of more than `least` rows is dealt into blocks by a hash, and each pair of blocks meets under a key of its own, so
    that no task makes all pairs of a hot group; a row is copied once for each block, and every pair is still made.
    """
    hot = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select(by, F.ceil(F.col("n") / least).cast("int").alias("blocks"))
    dealt = rows.join(hot, by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = dealt.select(by, F.col("id").alias("a"), F.col("own").alias("at_a"), F.col("other").alias("at_b"))
    b = dealt.select(by, F.col("id").alias("b"), F.col("other").alias("at_a"), F.col("own").alias("at_b"))
    return a.join(b, [by, "at_a", "at_b"]).where("a < b").select("a", "b")


def overlap_classes(sets: DataFrame) -> DataFrame:
    """id, cls, n: the class of each id, which is the smallest id with an equal set, and the size of its set. sets: id, item.

    Sets go by the count and two order-free 64-bit sums of their items' hashes, so no set is brought together as an array.
    """
    s = sets.select("id", "item").where("id is not null and item is not null").distinct()
    h = [F.xxhash64("item"), F.xxhash64(F.lit("second"), "item")]
    whole = s.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h[0]).alias("h1"), F.bit_xor(h[1]).alias("h2"))
    classes = whole.groupBy("n", "h1", "h2").agg(F.min("id").alias("cls"))
    return whole.join(classes, ["n", "h1", "h2"]).select("id", "cls", "n")


def blocked_join(small: DataFrame, large: DataFrame, by: str, least: int = 1000) -> DataFrame:
    """The inner join of small (with an id `a`) and large (with an id `b`) by one column.

    Where a key has more than `least` rows on a side, this side is dealt into blocks by a hash of its id and the other side is copied
    for each of them, so that no task joins all rows of a hot key.
    """
    ends = small.select(by, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(large.select(by, F.lit(0).alias("a"), F.lit(1).alias("b")))
    n = ends.groupBy(by).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where((F.col("a") > least) | (F.col("b") > least))
    hot = n.select(by, *(F.greatest(F.lit(1), F.ceil(F.col(c) / least)).cast("int").alias(f"blocks_{c}") for c in "ab"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        blocks = {c: F.coalesce(f"blocks_{c}", F.lit(1)) for c in "ab"}
        at = F.explode(F.sequence(F.lit(0), blocks[other] - 1)).alias(f"at_{other}")
        return df.join(hot, by, "left").select(*df.columns, F.pmod(F.xxhash64(own), blocks[own]).cast("int").alias(f"at_{own}"), at)

    return dealt(small, "a", "b").join(dealt(large, "b", "a"), [by, "at_a", "at_b"]).drop("at_a", "at_b")


def distinct_sets(sets: DataFrame) -> DataFrame:
    """id, item: the distinct rows without nulls, kept so that classes and pairs don't make them again."""
    return cut(sets.select("id", "item").where("id is not null and item is not null").distinct())


def class_pairs(sets: DataFrame, members: DataFrame, least: float = 0.5, wide: int = 64) -> DataFrame:
    """a, b, shared, overlap, size_a, size_b: pairs of classes (a < b) whose sets overlap by `least` of the smaller one, with the ids in each
    class. sets: id, item, as distinct_sets gives them; members: see overlap_classes.

    Items go from rare to frequent. A smaller set that shares k of its n items has one of its first n - k + 1 in common with the larger one,
    so only these look for larger sets, and what a hot item alone pairs is not made unless it is in the result. Sets of at most `wide`
    items travel with each of their items: a pair is counted where it is met, at its first shared item, and is not shuffled. Pairs
    with a larger set beyond that are made at each shared item and counted by a shuffle.
    """
    known = members.groupBy(F.col("cls").alias("id")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("size"))
    rows = sets.join(known, "id")
    rows = cut(rows.join(rows.groupBy("item").agg(F.count(F.lit(1)).alias("often")), "item"))

    def side(df: DataFrame, c: str, *more: str) -> DataFrame:
        return df.select("item", F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "size", *more)))

    once = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    ends = ["a", "b", "n_a", "n_b", "size_a", "size_b"]
    listed = F.sort_array(F.collect_list(F.struct("often", "item"))).getField("item")
    at = rows.where(F.col("n") <= wide).groupBy("id", "n", "size").agg(listed.alias("items")).select("*", F.posexplode("items").alias("at", "item"))
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * (least - 1e-9)))  # not above the true bound
    met = blocked_join(side(at.where(F.col("at") <= F.col("n") - k), "a", "items"), side(at, "b", "items"), "item").where(once)
    met = met.select("item", *ends, F.explode(F.array(F.array_intersect("items_a", "items_b"))).alias("common"))  # exploded, so that it is made once
    met = met.where(F.col("common")[0] == F.col("item")).select(*ends, F.size("common").cast("long").alias("shared"))
    counted = blocked_join(side(rows, "a"), side(rows.where(F.col("n") > wide), "b"), "item").where(once).groupBy(*ends).agg(F.count(F.lit(1)).alias("shared"))
    near = met.unionByName(counted).withColumn("overlap", F.col("shared") / F.least("n_a", "n_b")).where(F.col("overlap") >= least)

    def ordered(x: str, y: str) -> Column:
        return F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x)

    return near.select(ordered("a", "b"), ordered("b", "a"), "shared", "overlap", ordered("size_a", "size_b"), ordered("size_b", "size_a"))


def overlap_pairs(sets: DataFrame, least: float = 0.5) -> DataFrame:
    """a, b, shared, overlap: pairs of classes (a < b) whose sets overlap by `least` of the smaller one. sets: id, item.

    Ids with equal sets make one class, named by its smallest id, see overlap_classes; their pairs follow from the membership and are not
    written out. Sets with nothing in common are never paired.
    """
    sets = distinct_sets(sets)
    return class_pairs(sets, overlap_classes(sets), least).select("a", "b", "shared", "overlap")


def overlap_links(sets: DataFrame, least: float = 0.5) -> DataFrame:
    """id, cls, n_links: the class of each id and how many other ids overlap its set by `least`, counted by class and not as pairs."""
    sets = distinct_sets(sets)
    members = overlap_classes(sets)
    size = members.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
    pairs = class_pairs(sets, members, least)
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("cls"), F.col("size_b").alias("size")), F.struct(F.col("b").alias("cls"), F.col("size_a").alias("size")))))
    others = ends.groupBy("cls").agg(F.sum("size").alias("others"))
    return members.join(size, "cls").join(others, "cls", "left").select("id", "cls", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def latest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order; the window holds one group's rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")

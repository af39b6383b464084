"""Column expressions and patterns for paths: languages, roles, ignore rules, groups."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: language of a file extension (fixed values)
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "tsx", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java"}
#: extensions that are never read as text (fixed values)
DENIED_EXTENSIONS = [
    "zip", "gz", "tar", "7z", "rar", "exe", "dll", "so", "dylib", "bin", "dat", "wasm", "class", "jar", "pyc", "pyo", "o", "a", "png",
    "jpg", "jpeg", "gif", "webp", "ico", "svg", "mp4", "mov", "mp3", "wav", "pdf", "ttf", "otf", "woff", "woff2", "eot", "map",
]
#: lock files, skipped by name without case (fixed values)
DENIED_NAMES = [
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "cargo.lock", "gemfile.lock", "poetry.lock", "go.sum", "composer.lock",
]
#: directories that a walk never enters (fixed values)
DEFAULT_IGNORES = [".git/", "node_modules/", "dist/", "coverage/"]
#: ignore-style patterns of the roles, the first role that matches holds (fixed values)
ROLE_PATTERNS = {
    "fixture": ["**/test/fixtures/**", "**/tests/fixtures/**", "**/__tests__/fixtures/**", "**/__fixtures__/**", "**/testdata/**"],
    "test": ["**/*.test.*", "**/*.spec.*", "**/__tests__/**", "**/test_*.py", "**/*_test.py", "**/*_test.go", "**/*Test.java", "**/*Tests.java", "**/*Test.kt", "**/*Spec.kt", "**/*Spec.scala", "**/*Suite.scala", "**/*Tests.cs", "**/src/test/java/**", "**/src/test/kotlin/**"],
    "tooling": ["**/scripts/**", "**/tools/**", "**/benchmarks/**"],
    "docs": ["docs/**", "**/docs/**"],
}
#: patterns of the signals of a flow (fixed values)
ENTRY_PATTERNS = ["bin/**", "cmd/**", "**/cli.*", "**/main.*", "**/server.*", "**/app.*"]
STORE_PATTERNS = ["**/db.*", "**/database/**", "**/store/**", "**/state/**", "**/persistence/**", "**/repository/**"]
#: version of the extraction by extension (fixed values)
EXTRACTIONS = {"ts": "ts-v1", "tsx": "tsx-v1", "jsx": "tsx-v1", "js": "js-v1", "mjs": "js-v1", "cjs": "js-v1", "py": "py-v1", "go": "go-v1", "rs": "rust-v1", "java": "java-v1"}
#: words in a file's first eight lines that mark it as generated, in lower case (fixed values)
GENERATED_MARKS = ["do not edit", "@generated", "code generated", "auto-generated"]
#: a test by the narrow rule: by file name, or in a directory for tests (fixed value)
NARROW_TEST = r"(^|/)[^/]*\.(test|spec)\.[^/]*$|(^|/)__tests__(/|$)|(^|/)test_[^/]+\.py$|_test\.(py|go)$"


def glob_regex(pattern: str) -> str:
    """A regular expression without lookarounds for one ignore-style pattern (not a negation), for paths with forward slashes.

    A slash at the start or inside anchors the pattern to the root, a slash at the end asks for a directory, `**` spans
    directories, and what matches a directory matches everything in it.
    """
    p = pattern.strip()
    only_dir = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out += "(.*/)?"
            i += 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            return "^" + ("" if anchored else "(.*/)?") + out + "/.+$"
        elif p.startswith("**", i):
            out += ".*"
            i += 2
        elif c == "*":
            out += "[^/]*"
            i += 1
        elif c == "?":
            out += "[^/]"
            i += 1
        elif c == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            body = p[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            i = j + 1
        elif c == "\\" and i + 1 < len(p):
            out += re.escape(p[i + 1])
            i += 2
        else:
            out += re.escape(c) if not c.isalnum() and c not in "_/" else c
            i += 1
    return "^" + ("" if anchored else "(.*/)?") + out + ("/.+$" if only_dir else "(/.*)?$")


def any_pattern_regex(patterns: list[str]) -> str:
    """One regular expression for a list of patterns without negations."""
    return "|".join(f"({glob_regex(p)})" for p in patterns) or "^$a"


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether ignore-style patterns match a path; a later pattern that starts with `!` takes matches back. No pattern matches nothing."""
    p = slashed(path)
    if not any(x.startswith("!") for x in patterns):
        return p.rlike(any_pattern_regex(patterns)) if patterns else F.lit(False)
    out = F.lit(False)
    for x in patterns:
        out = F.when(p.rlike(glob_regex(x.lstrip("!"))), F.lit(not x.startswith("!"))).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """The directory of a path, `` at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)).otherwise("")


def extension(path: Column) -> Column:
    """The extension in lower case without its dot; `` if there is none or the name only starts with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def language(path: Column) -> Column:
    """The language of the extension, else the extension itself."""
    return F.coalesce(_lookup(extension(path), LANGUAGES), extension(path))


def tier(lang: Column) -> Column:
    """`anchored` for languages that are parsed into symbols, else `prose`."""
    return F.when(F.coalesce(lang.isin(*sorted(set(LANGUAGES.values()))), F.lit(False)), "anchored").otherwise("prose")


def extraction_version(key: Column) -> Column:
    return _lookup(extension(key_path(key)), EXTRACTIONS)


def key_path(key: Column) -> Column:
    """The path of a symbol key; null without a `#` or if it starts with one."""
    return F.when(F.instr(key, "#") > 1, F.substring_index(key, "#", 1))


def key_name(key: Column) -> Column:
    return F.when(F.instr(key, "#") > 1, F.substring(key, F.instr(key, "#") + 1, F.length(key)))


def path_role(path: Column, patterns: dict[str, list[str]] | None = None) -> Column:
    """fixture, test, tooling, docs or product; a given category replaces the built-in patterns of its name."""
    rules = ROLE_PATTERNS | (patterns or {})
    out = F.lit("product")
    for role in ("docs", "tooling", "test", "fixture"):
        out = F.when(matches_any(path, rules[role]), role).otherwise(out)
    return out


def narrow_test(path: Column) -> Column:
    return slashed(path).rlike(NARROW_TEST)


def denied(path: Column, ignores: list[str] = DEFAULT_IGNORES) -> Column:
    """Why a path is not walked: `extension`, `name`, `minified`, `no extension`, `ignored`; null if it is. ignores: ignore-style
    patterns, the built-in ones and those of the folder in which pages are kept."""
    name = F.lower(base_name(path))
    return (
        F.when(matches_any(path, ignores), "ignored")
        .when(F.instr(base_name(path), ".") == 0, "no extension")
        .when(extension(path).isin(*DENIED_EXTENSIONS), "extension")
        .when(name.isin(*DENIED_NAMES), "name")
        .when(name.endswith(".min.js") | name.endswith(".min.css"), "minified")
    )


def generated_header(content: Column) -> Column:
    head = F.lower(F.substring_index(content, "\n", 8))
    return F.greatest(*[F.instr(head, m) > 0 for m in GENERATED_MARKS])


def external_specifier(s: Column) -> Column:
    return (s != "") & ~s.startswith("node:") & ~s.startswith(".") & ~s.startswith("/")


def assignee(in_manual_block: Column, owner: Column) -> Column:
    """`human` for what stands in a manual block or on a human's page, else `agent`."""
    return F.when(F.coalesce(in_manual_block, F.lit(False)) | F.coalesce(owner == "human", F.lit(False)), "human").otherwise("agent")


def page_group(wiki_path: Column) -> Column:
    """The sidebar group of a page, by ordered rules; the first segment of wiki_path names the folder that holds the pages."""
    at = F.instr(wiki_path, "/")
    rel = F.when(at > 0, F.substring(wiki_path, at + 1, F.length(wiki_path))).otherwise(wiki_path)
    name = base_name(rel)
    return (
        F.when(rel == "quickstart.md", "Quickstart")
        .when(wiki_path.endswith(".mmd"), "Diagrams")
        .when(rel.startswith("topics/") & (name != "index.md"), "Concept topics")
        .when(rel.startswith("flows/") & (name != "index.md"), "Flows")
        .when(rel.startswith("auxiliary/") & (name != "index.md"), "Auxiliary areas")
        .when(rel.startswith("architecture/"), "Indexes & overviews")
        .when((F.instr(rel, "/") == 0) & (rel != "tasks.md"), "Implementation reference")
        .when(rel.rlike(r"^[^/]+/[^/]+\.md$"), "Implementation reference")
        .otherwise("Indexes & overviews")
    )


def path_prefixes(path: Column) -> Column:
    """Every directory above a path, from the top, as an array."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))  # a sequence from 1 to 0 would count down


def resolve_relative(page: Column, link: Column) -> Column:
    """A relative link as seen from a page, with dot segments resolved; it keeps `..` that lead out of the root."""
    from codeloom.functions.keys import normal_path

    return normal_path(F.concat_ws("/", dir_name(page), link))

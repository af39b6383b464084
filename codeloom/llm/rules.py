"""What a file's own text and name say about who made it: a person, a generator, a compiler, a minifier, a data dump."""

from __future__ import annotations

import re
from collections.abc import Iterator

_FILE = r"(?:(?:this|the)\s+)?(?:source\s+)?(?:file|code|class|module|script)?\s*(?:is|was|has been)?\s*"
#: clauses by which a head says that a tool made the file (fixed values); each is looked for at the start of a clause, so that a
#: comment that only speaks of generated files doesn't count
HEAD_MARKS = [
    r"@generated\b", r"<auto-?generated\b", _FILE + r"(?:auto(?:matically)?[- ]?|machine[- ])generated\b(?!\s+(?:\w+s|output)\b)", _FILE + r"generated\s+(?:automatically\s+)?(?:by|from|with|using|on|at)\b",
    r"(?:this\s+)?(?:file|code|class|module|script)\s+(?:is|was|has been)\s+(?:automatically\s+)?(?:produced|emitted|created automatically|written automatically)\s+(?:by|from)\b",
    r"(?:please\s+)?(?:do not|don't|never)\s+(?:edit|modify|change)(?:\s+(?:this|it|file|by hand|manually|directly|here))*\s*(?:[.;:,!*/]|$)",
    r"(?:(?:manual|all|any|your|hand)\s+)*(?:edits|changes|modifications)(?:\s+(?:to this file|made here))?\s+(?:are|will be|get)\s+(?:overwritten|lost|discarded)\b",
    r"(?:diese datei|dieser code)\s+(?:wurde|ist)\s+automatisch\b", r"automatisch (?:erzeugt|generiert|erstellt)\b", r"(?:(?:este|esta)\s+)?(?:arquivo|archivo|c[óo]digo)?\s*(?:foi\s+|fue\s+)?(?:gerado|generado)\s+autom[áa]ticamente\b",
    r"(?:ce\s+)?(?:fichier|code)?\s*(?:a été\s+)?g[ée]n[ée]r[ée]\s+automatiquement\b", r"(?:questo\s+)?(?:file|codice)?\s*(?:è stato\s+)?generato\s+automaticamente\b", r"(?:этот\s+)?(?:файл|код)?\s*(?:был\s+)?(?:автоматически\s+)?(?:сгенерирован|создан)\w*(?:\s+автоматически)?\b", r"\W*自動生成", r"\W*自动生成", r"αυτόματα\b",
]
_HEAD = re.compile("(?i)(?:" + "|".join(HEAD_MARKS) + ")")
_MARKER = re.compile(r"(?:/{2,}!?|/\*+!?|\*+/?|#+!?|--+|;+|<!--|\"{3}|'{3})\s*")
_CLAUSE = re.compile(r"(?<=[.;:!?])\s+|,\s+|\s+[-–—]+\s+")
#: names of files that tools write (fixed values)
MADE_NAME = re.compile(
    r"(?:\.(?:gen|generated|g|pb|pb\.gw|designer|autogen)\.[A-Za-z]+|_(?:pb2|pb2_grpc|generated|gen)\.[A-Za-z]+|(?:_string|_enumer)(?:\.gen)?\.go|Grpc(?:\.gen)?\.java|\.min\.(?:js|css)|[-_]min\.(?:js|css)|\.bundle\.js|\.chunk\.js)$"
)
#: directories whose files tools write (fixed values)
MADE_DIR = re.compile(r"(?:^|/)(?:generated|__generated__|gen|autogen|auto-generated|generated-sources|generated-src)/")
BUILT_DIR = re.compile(r"(?:^|/)(?:dist|build/out|out|target/classes)/")

_COMMENT_START = {"py": ("#",), "pyi": ("#",)}
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\s\w]")
_DIGITS = re.compile(r"\d+")
#: the statement by which a transpiler marks a module (fixed value)
_BOILERPLATE = re.compile(r"(?m)(?:^|[;{},)])[ \t]*Object\.defineProperty\(\s*exports\s*,\s*[\"']__esModule[\"']")
_STRICT = re.compile(r"[\"']use strict[\"']")
_TEMPLATE = re.compile(r"`(?:[^`\\]|\\.)*`", re.S)
_FUNCTION = re.compile(r"(?m)^\s*(?:export\s+|pub(?:\([a-z]+\))?\s+|public\s+|private\s+|static\s+|async\s+|final\s+)*(?:def|function|func|fn|[A-Za-z_][\w<>\[\]]*\s+[A-Za-z_]\w*)\s*[\w$]*\s*\(")


def _each_line(text: str) -> Iterator[str]:
    """The lines one by one, so that a long text isn't split for its head."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


def head_lines(text: str, ext: str) -> list[str]:
    """The comment lines before a file's first line of code."""
    got, inside = [], ""
    for line in _each_line(text):
        s = line.strip().lstrip("﻿")
        if inside:
            got.append(s)
            if inside in s:
                inside = ""
            continue
        if not s:
            continue
        if ext in _COMMENT_START:
            if s.startswith("#"):
                got.append(s)
                continue
            m = re.match(r"[rRuU]?(\"\"\"|''')", s)
            if m:
                got.append(s)
                inside = "" if m[1] in s[m.end() :] else m[1]
                continue
            break
        if s.startswith("//"):
            got.append(s)
        elif s.startswith("/*"):
            got.append(s)
            inside = "" if "*/" in s[2:] else "*/"
        elif s.startswith("#!") or s in ('"use strict";', "'use strict';"):
            continue
        else:
            break
    return got


def generated_head(text: str, ext: str) -> bool:
    """Whether a clause of the head, at its start, says that a tool made the file."""
    ended = True
    for line in head_lines(text, ext):
        while m := _MARKER.match(line):
            line = line[m.end() :]
        # a line goes on with the sentence of the line before unless that one ended
        clauses = _CLAUSE.split(line)
        if any((k or ended or x[:1].isupper() or x[:1] in "@<") and _HEAD.match(x) for k, x in enumerate(clauses)):
            return True
        ended = not line.strip() or line.rstrip()[-1] in ".:;!?>/*"
    return False


def _code(text: str, ext: str) -> str:
    """The text without comment lines."""
    if ext in _COMMENT_START:
        return re.sub(r"(?m)^\s*#.*$", "", text)
    return re.sub(r"(?m)^\s*//.*$", "", re.sub(r"/\*.*?\*/", "", text, flags=re.S))


def minified(code: str, ext: str) -> bool:
    """Whether most of a script is in long lines made of short names without blanks."""
    if ext not in ("js", "mjs", "cjs", "ts", "css", "jsx", "tsx"):
        return False
    lines = [x for x in code.split("\n") if x.strip()]
    size = sum(map(len, lines))
    if not size:
        return False
    long = [x for x in lines if len(x) > 200]
    body = "".join(long)
    if len(body) < 0.5 * size or len(body) < 200:
        return False
    names = _WORD.findall(_STRING.sub("", body))
    short = sum(len(x) <= 2 for x in names)
    blanks = body.count(" ") + body.count("\t")
    return blanks < 0.12 * len(body) and short > 0.35 * max(1, len(names))


def data_body(code: str) -> bool:
    """Whether almost all of a file is one listing of literals."""
    size = len(code.strip())
    if size < 400:
        return False
    bare = _STRING.sub("", code)
    bare = re.sub(r"\b(?:0[xX][0-9a-fA-F]+|[-+]?\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?[fFLuU]?)\b", "", bare)
    names = _WORD.findall(bare)
    return len(names) <= 12 + size // 2000 and sum(map(len, names)) < 0.05 * size


def repetitive(code: str, share: float = 0.8) -> bool:
    """Whether a file is made of a few statements repeated with a counter: `share` of its lines, without mere brackets, have the tokens
    of at least two others but for names and numbers, and a number that rises from one of these lines to the next, nine times of ten."""
    shapes: dict[str, list[list[int]]] = {}
    lines = [x for x in code.split("\n") if x.strip(" \t\r;})](")]
    numbered = [x for x in lines if _DIGITS.search(x)]
    if len(lines) < 6 or len(numbered) < share * len(lines):
        return False
    for line in numbered:
        shape, numbers = [], []
        for x in _TOKEN.findall(line):
            digits = _DIGITS.findall(x) if x[0] not in "\"'" else []
            numbers += digits
            shape.append("s" if x[0] in "\"'" else "9" if x[0].isdigit() else ("n" if digits else "w") if x[0].isalpha() or x[0] in "_$" else x)
        if numbers:
            shapes.setdefault("".join(shape), []).append([int(x[:18]) for x in numbers])
    counted = sum(len(v) for v in shapes.values() if len(v) >= 3 and any(sum(b > a for a, b in zip(c, c[1:])) >= 0.9 * (len(c) - 1) for c in zip(*v)))
    return counted >= share * len(lines)


def _last_line(text: str) -> str:
    return text.rstrip().rpartition("\n")[2]


def compiled(text: str) -> bool:
    """Whether a transpiler wrote it: module boilerplate as a statement, wherever the comments and helpers before it end, in
    strict mode or with a source map's name at the end."""
    if "__esModule" not in text:
        return False
    code = _TEMPLATE.sub("``", _code(text, "js"))
    if not _BOILERPLATE.search(code):
        return False
    return bool(_STRICT.search(code)) or bool(re.match(r"//# sourceMappingURL=\S+$", _last_line(text).strip()))


def judge(path: str, ext: str, text: str | None) -> str | None:
    """`generated`, `compiled`, `minified` or `data`, or None for what a person may have written."""
    if not text:
        return None
    text = text.replace("\r\n", "\n")
    code = _code(text, ext)
    if compiled(text):
        return "compiled"
    if minified(code, ext):
        return "minified"
    if generated_head(text, ext):
        return "generated"
    if data_body(code):
        return "data"
    if repetitive(code):
        return "generated"
    name = path.rsplit("/", 1)[-1]
    # a telling name or place alone is not enough where the text is prose-like source with its own documentation
    if MADE_NAME.search(name) or MADE_DIR.search(path):
        return "generated"
    if BUILT_DIR.search(path) and ext in ("js", "mjs", "cjs", "css") and _last_line(text).lstrip().startswith("//# sourceMappingURL="):
        return "compiled"
    return None

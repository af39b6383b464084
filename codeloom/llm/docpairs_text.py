"""Text side of function/documentation pairing: find a function's own documentation and judge it.

Everything here works on one file's text and is pure Python, so it can be tested without Spark.
"""

from __future__ import annotations

import re

#: file extension -> language family (fixed values)
EXT_LANG = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "rs": "rust", "go": "go",
}
#: spelling of the lang column -> language family (fixed values)
LANG_NAMES = {
    "python": "python", "py": "python", "typescript": "typescript", "ts": "typescript", "javascript": "javascript", "js": "javascript",
    "java": "java", "rust": "rust", "rs": "rust", "go": "go", "golang": "go",
}
#: texts that stand in for documentation that nobody wrote yet (fixed values)
PLACEHOLDERS = {
    "todo", "fixme", "xxx", "tbd", "tba", "wip", "na", "none", "placeholder", "documentation", "description", "docs", "doc", "docstring", "comment",
    "helper", "internal", "internal use only", "undocumented", "no documentation", "no description", "add description here", "description goes here",
    "inheritdoc", "see above", "see below", "same as above", "self explanatory", "missing documentation", "to be documented", "to be done", "document me",
    "lorem ipsum", "no description provided", "no description available", "no documentation available", "description goes here", "do it", "utility", "same as before", "auto generated", "auto generated method stub", "not documented", "documentation pending", "write documentation", "add documentation",
}
#: words that add nothing to a repeated name (fixed values)
FILLER = {
    "a", "an", "the", "this", "that", "is", "it", "its", "of", "for", "to", "and", "or", "in", "function", "func", "method", "procedure", "routine", "helper",
    "implementation", "implements", "impl", "definition", "does", "do", "call", "calls", "called", "name", "member", "here", "which", "fn", "def", "async",
}
#: tags of documentation comments that carry a name before the description (fixed values)
NAMED_TAGS = {"param", "parameter", "arg", "argument", "property", "prop", "typeparam", "template", "throws", "exception", "raises", "raise", "key", "keyword", "var", "type"}
SECTIONS = {"args", "arguments", "parameters", "params", "returns", "return", "raises", "yields", "examples", "example", "note", "notes", "attributes", "see also", "throws", "errors", "panics", "safety", "keyword args", "other parameters", "warns", "references"}

LEAST = 20


def language(path: str | None, lang: str | None) -> str | None:
    """Language by the path's extension, else by the lang column in any of its spellings."""
    ext = (path or "").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    return EXT_LANG.get(ext) or LANG_NAMES.get((lang or "").strip().lower())


def lines_of(content: str) -> list[str]:
    """Lines by line feed, without a carriage return at their ends and without a byte order mark."""
    if content.startswith("﻿"):
        content = content[1:]
    return [x[:-1] if x.endswith("\r") else x for x in content.split("\n")]


_STRING = re.compile(r"([A-Za-z]{0,2})(\"\"\"|'''|\"|')")


def python_doc(lines: list[str], start: int, end: int) -> tuple[str | None, int]:
    """Docstring of the def whose lines are start..end (from 1), and the line after the header; None if there is none."""
    text = "\n".join(lines[start - 1 : end])
    m = re.search(r"^[ \t]*(?:async[ \t]+)?(?:def|class)\b", text, re.M)
    if not m:
        return None, start
    i, depth, n = m.end(), 0, len(text)
    while i < n:  # to the colon that ends the header
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "#":
            i = text.find("\n", i)
            if i < 0:
                return None, start
            continue
        elif c in "\"'":
            q = text[i : i + 3] if text[i : i + 3] in ('"""', "'''") else c
            j = _close(text, i + len(q), q)
            if j < 0:
                return None, start
            i = j + len(q)
            continue
        elif c == ":" and depth <= 0:
            break
        i += 1
    else:
        return None, start
    i += 1
    while i < n:  # blanks, comments and line ends before the first statement
        if text[i] in " \t\n\r\f" or text[i] == "﻿":
            i += 1
        elif text[i] == "#":
            j = text.find("\n", i)
            i = n if j < 0 else j + 1
        elif text[i] == "\\" and text[i + 1 : i + 2] == "\n":
            i += 2
        else:
            break
    parts: list[str] = []
    while s := _STRING.match(text, i):
        prefix, q = s[1].lower(), s[2]
        if prefix not in ("", "r", "u"):
            return None, start
        j = _close(text, s.end(), q, raw="r" in prefix)
        if j < 0:
            return None, start
        parts.append(text[s.end() : j])
        i = j + len(q)
        while i < n and text[i] in " \t":
            i += 1
    if not parts:
        return None, start
    rest = text[i : text.find("\n", i) if "\n" in text[i:] else n].strip()
    if rest and rest[0] not in "#;":
        return None, start  # the string is part of an expression
    return "".join(parts), start + text.count("\n", 0, i)


def _close(text: str, i: int, q: str, raw: bool = False) -> int:
    """Index of the closing quote from i on, -1 if there is none."""
    while True:
        j = text.find(q, i)
        if j < 0 or (len(q) == 1 and "\n" in text[i:j]):
            return -1
        back = 0
        while j - back - 1 >= i and text[j - back - 1] == "\\":
            back += 1
        if back % 2 == 0:
            return j
        i = j + 1


def _above(lines: list[str], start: int, attribute: str) -> int:
    """Index (from 0) of the line right above start and its attributes; -1 if there is none."""
    i = start - 2
    while i >= 0:
        s = lines[i].strip()
        if not s:
            return -1
        if s.startswith(attribute):
            i -= 1
            continue
        if s[-1] in ")]}" and not s.endswith("*/") and not s.startswith("//"):  # end of an attribute of several lines?
            depth, j = 0, i
            while j >= 0 and lines[j].strip():
                depth += sum(lines[j].count(c) for c in ")]}") - sum(lines[j].count(c) for c in "([{")
                if depth <= 0:
                    break
                j -= 1
            if j >= 0 and j < i and lines[j].strip().startswith(attribute):
                i = j - 1
                continue
        return i
    return -1


def comment_doc(lines: list[str], start: int, lang: str) -> tuple[str | None, int]:
    """Documentation comment above line start (from 1) by the language's rules, and its first line."""
    i = _above(lines, start, "#[" if lang == "rust" else "@")
    if lang == "go":
        i = start - 2
    if i < 0 or not lines[i].strip():
        return None, start
    s = lines[i].strip()
    if s.endswith("*/"):
        j = i
        while j >= 0 and "/*" not in lines[j]:
            j -= 1
            if j >= 0 and "*/" in lines[j]:
                return None, start
        if j < 0:
            return None, start
        head = lines[j].strip()
        if not head.startswith("/*"):
            return None, start  # it follows code on its line
        body = "\n".join(x.strip() for x in lines[j : i + 1])
        if body.count("*/") > 1:
            body = body[body.rindex("/*") :]
        if lang == "go":
            return (_block(body), j + 1) if not body.startswith("/*line ") else (None, start)
        if not body.startswith("/**") or body in ("/**/", "/***/") or (lang == "rust" and body.startswith("/***")):
            return None, start
        return _block(body), j + 1
    if lang == "rust":
        mark = re.compile(r"///(?!/)")
    elif lang == "go":
        mark = re.compile(r"//")
    else:
        return None, start
    j = i
    while j >= 0 and mark.match(lines[j].strip()):
        j -= 1
    if j == i:
        return None, start
    got = [lines[k].strip()[3 if lang == "rust" else 2 :] for k in range(j + 1, i + 1)]
    if lang == "go":
        got = [x for x in got if not re.match(r"(?:go:\w+|line |export \w|nolint\b|\+build\b)", x)]
        if not got:
            return None, start
    return "\n".join(got), j + 2


def _block(body: str) -> str:
    inner = re.sub(r"^/\*+", "", body)
    inner = re.sub(r"\*+/$", "", inner)
    return "\n".join(re.sub(r"^\s*\*+(?!\*)[ \t]?", "", x) if k else x for k, x in enumerate(inner.split("\n")))


def documentation(lines: list[str], start: int, end: int, lang: str | None) -> tuple[str | None, int]:
    if lang is None or start is None or end is None or start < 1 or start > len(lines):
        return None, 0
    return python_doc(lines, start, max(start, end)) if lang == "python" else comment_doc(lines, start, lang)


def words(text: str) -> list[str]:
    """Words of a text or an identifier, in lower case; humps and underscores part words."""
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", text)
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


def prose(doc: str) -> str:
    """The text that a reader sees: without mark-up, rules and tags that describe nothing."""
    doc = re.sub(r"(?i)\{@?inheritdoc\}|@inheritdoc\b", " ", doc)
    doc = re.sub(r"\{@\w+\s*([^}]*)\}", r"\1", doc)
    doc = re.sub(r"</?[A-Za-z][^<>\n]*>", " ", doc)
    doc = re.sub(r"`+|\*\*|__(?=\w)|(?<=\w)__|\[([^\]]*)\]\([^)]*\)", lambda m: m[1] or "", doc)
    kept, section = [], False
    for line in doc.split("\n"):
        s = line.strip().strip("*").strip()
        if not s:
            section = section and not kept
            continue
        if re.fullmatch(r"[-=~#*_.\s]+", s):
            continue
        head = re.match(r"(?:#+\s*)?([A-Za-z ]+):?\s*$", s)
        if head and head[1].strip().lower() in SECTIONS and (s.endswith(":") or s.startswith("#")):
            section = True
            continue
        tag = re.match(r"[@\\:]([A-Za-z]+)\b:?\s*(.*)$", s)
        if tag:
            rest = re.sub(r"^\{[^}]*\}\s*", "", tag[2])
            if tag[1].lower() in NAMED_TAGS:
                rest = re.sub(r"^\[?[\w.$<>=\-\"']+\]?:?\s*(?:-\s*)?", "", rest)
            s = rest.strip(" -:")
        elif section:
            s = re.sub(r"^[-*]?\s*[\w.$*]+\s*(?:\([^)]*\))?\s*(?::|-|--)(?:\s+|$)", "", s) if re.match(r"^[-*]?\s*[\w.$*]+\s*(?:\([^)]*\))?\s*(?::|-)", s) else ("" if re.fullmatch(r"[\w.$*]+", s) else s)
        else:
            s = re.sub(r"^#+\s+", "", s)
        if s:
            kept.append(s)
    return " ".join(" ".join(kept).split())


def worthwhile(doc: str | None, name: str | None, least: int = LEAST, placeholders: set[str] = PLACEHOLDERS, filler: set[str] = FILLER) -> bool:
    """Whether a documentation text says something: `least` characters without mark-up, no placeholder, more than the name with
    filler, more than bare tags. placeholders: whole texts in lower case without punctuation; filler: words in lower case."""
    if doc is None:
        return False
    text = prose(doc)
    if len(text) < least:
        return False
    said = words(text)
    if not said:
        return False
    if " ".join(said) in placeholders:
        return False
    bare = re.sub(r"(?i)^(?:todo|fixme|xxx|tbd|hack)\b[\s:(\w)-]*?[:\s-]\s*", "", text)
    if re.match(r"(?i)(?:todo|fixme|xxx|tbd)\b", text) and (len(bare) < least or " ".join(words(bare)) in placeholders or re.match(r"(?i)(?:document|describe|write|add|explain|fill)\b", bare)):
        return False
    own = set(words((name or "").replace("#", "."))) | {"".join(words((name or "").rpartition(".")[2])), "".join(words(name or ""))}
    last = set(words((name or "").rpartition(".")[2]))
    rest = [w for w in said if w not in own and w not in filler]
    stems = {x.rstrip("s") for x in last} | {x.removesuffix("e") for x in last}
    rest = [w for w in rest if w.rstrip("s") not in stems and w.removesuffix("s").removesuffix("e") not in stems]
    return bool(rest)

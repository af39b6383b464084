"""Declarations as a file has them, and their normalised signatures: what tells overloads of one name apart.

Everything here works on one file's lines and is pure Python.
"""

from __future__ import annotations

import re

#: words before a parameter's type or name that don't tell overloads apart (fixed values)
MODIFIERS = {"final", "const", "mut", "readonly", "public", "private", "protected", "static", "override", "ref"}
#: words that open a type in Go, so that what follows is no name (fixed values)
GO_TYPES = {"chan", "func", "map", "struct", "interface"}
_QUOTED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_CHARACTER = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'")
#: a string that may stand for a type, as annotations of Python have them
_NAMED = re.compile(r"(['\"])[\w. |]*(?:\[[\w., |\[\]]*\])?\1")
_COMMENTS = re.compile(r"/\*.*?\*/|//[^\n]*", re.S)
_PLAIN = re.compile(r"[A-Za-z_$][\w$]*")
_LETTER = re.compile(r"[\w$]")
_NESTED = re.compile(r"[(\[{<]")
#: an arrow function of one parameter without brackets
_LONE = re.compile(r"=\s*(?:async\s+)?([A-Za-z_$][\w$]*)\s*=>$")
_OPEN, _SHUT = "([{", ")]}"


def bare(text: str, lang: str | None) -> str:
    """The text with the insides of strings and comments blanked out, so that brackets in them don't count."""
    if lang == "python":
        if '"' in text or "'" in text:
            text = re.sub(r"\"\"\".*?\"\"\"|'''.*?'''", '""', text, flags=re.S)
            text = _QUOTED.sub(lambda m: m[0] if _NAMED.fullmatch(m[0]) else '""', text)
        return re.sub(r"#[^\n]*", "", text) if "#" in text else text
    if '"' in text or "'" in text or "`" in text:
        text = (_CHARACTER if lang == "rust" else _QUOTED).sub('""', text)  # a lifetime of Rust opens no string
    return _COMMENTS.sub(" ", text) if "/" in text else text


def header(lines: list[str], start: int, end: int, lang: str | None) -> str:
    """The declaration at lines start..end (from 1): from the first line that is no decorator to the opening of the body, or
    to the end of a declaration without one, however many lines that takes; blanks are made one, strings and comments blanked out."""
    got: list[str] = []
    text, depth, skipping = "", 0, False
    for i in range(start - 1, min(end, len(lines))):
        line = lines[i].strip()
        if not got and not skipping and (not line or line.startswith("#[") or (line.startswith("@") and not line.startswith("@interface")) or line.startswith(("//", "/*", "*"))):
            rest = bare(line, lang)
            depth = sum(rest.count(c) for c in _OPEN) - sum(rest.count(c) for c in _SHUT)
            if depth <= 0:  # an annotation may stand before the declaration on its line
                depth = 0
                after = re.sub(r"^(?:@[\w.]+\s*(?:\((?:[^()]|\([^()]*\))*\))?\s*|#\[(?:[^\[\]]|\[[^\[\]]*\])*\]\s*)+", "", rest)
                if not rest.startswith(("@", "#[")) or not after.strip():
                    continue
                line = after.strip()
            else:
                skipping = True
                continue
        elif skipping:
            rest = bare(line, lang)
            depth += sum(rest.count(c) for c in _OPEN) - sum(rest.count(c) for c in _SHUT)
            skipping = depth > 0
            depth = max(0, depth)
            continue
        got.append(line)
        text = bare("\n".join(got), lang)
        stop = _stop(text, lang)
        if stop is not None:
            return " ".join(text[:stop].split())
        if lang == "go" and sum(text.count(c) for c in "([") <= sum(text.count(c) for c in ")]") and text.rstrip()[-1:] not in ",(":
            break  # a declaration without a body ends with its line
    return " ".join(text.split())


def _stop(text: str, lang: str | None) -> int | None:
    """Where the header ends in a text without strings and comments: after the colon, bracket, semicolon or arrow that ends it."""
    depth, angles, seen = 0, 0, False
    for m in re.finditer(r"=>|->|[()\[\]{};:<>]", text):
        c = m[0]
        if c in ("<", ">"):
            if depth == 0 and lang not in ("python", "go"):
                angles = max(0, angles + (1 if c == "<" else -1))
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            seen = seen or depth == 0
        elif depth > 0:
            depth += (c == "{") - (c == "}")
        elif lang == "python":
            if c == ":":
                return m.end()
        elif angles:
            depth += c == "{"
        elif c == ";" or (c == "=>" and (seen or _LONE.search(text[: m.end()]))):
            return m.end()
        elif c == "{" and (seen or "(" not in text) and not (lang == "typescript" and text[: m.start()].rstrip()[-1:] in (":", "|", "&")):
            return m.end()
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
    return None


def has_body(head: str, path: str, lang: str | None) -> bool:
    """Whether a header belongs to a definition; a stub file of Python or a declaration file of TypeScript only declares."""
    if re.search(r"\.(?:pyi|d\.[mc]?ts)$", path):
        return False
    return lang == "python" or head.endswith(("{", "=>"))


def _split(text: str, angles: bool) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in _OPEN or (c == "<" and angles):
            depth += 1
        elif c in _SHUT or (c == ">" and angles and text[i - 1 : i] not in ("=", "-")):
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(text[at:i])
            at = i + 1
    parts.append(text[at:])
    return [p.strip() for p in parts if p.strip()]


def parameters(head: str, name: str | None, lang: str | None) -> list[str] | None:
    """The parameters in the brackets after the declared name; None if the text has no whole parameter list."""
    angles = lang != "python" and lang != "go"
    last = (name or "").rpartition(".")[2]
    at = 0
    if lang == "go" and (m := re.match(r"\s*func\s*\(", head)):
        at = _after(head, m.end() - 1)  # the receiver is no parameter
        if at < 0:
            return None
    at = _after_name(head, last, at)
    if head[at : at + 1] == "(" and (end := head.find(")", at)) > 0 and not _NESTED.search(inner := head[at + 1 : end]):
        return [p for x in inner.split(",") if (p := x.strip())]  # nothing nested in it
    depth = 0
    for i in range(at, len(head)):
        c = head[i]
        if c == "(" and depth == 0:
            end = _after(head, i)
            return None if end < 0 else _split(head[i + 1 : end - 1], angles)
        depth += (c in "[{" or (c == "<" and angles)) - (c in "]}" or (c == ">" and angles and head[i - 1] not in "=-"))
    m = _LONE.search(head)
    return [m[1]] if m and lang in ("typescript", "javascript") else None


def _after_name(head: str, name: str, at: int) -> int:
    """Index after the whole word `name` from `at` on; at if it isn't there."""
    i = head.find(name, at) if name else -1
    while i >= 0:
        end = i + len(name)
        if not _LETTER.match(head, end) and not (i and _LETTER.match(head, i - 1)):
            return end
        i = head.find(name, end)
    return at


def _after(text: str, at: int) -> int:
    """Index after the bracket that closes the one at `at`; -1 if none does."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in _OPEN) - (text[i] in _SHUT)
        if depth == 0:
            return i + 1
    return -1


def _unassigned(p: str) -> str:
    """A parameter without its default value."""
    depth = 0
    for i, c in enumerate(p):
        if c in _OPEN:
            depth += 1
        elif c in _SHUT:
            depth -= 1
        elif c == "=" and depth == 0 and p[i + 1 : i + 2] not in ("=", ">") and p[i - 1 : i] not in ("=", "!", "<", ">"):
            return p[:i].rstrip()
    return p


def _tight(t: str) -> str:
    return re.sub(r"\s*([^\w\s])\s*", r"\1", t.strip())


def _colon(p: str) -> int:
    depth = 0
    for i, c in enumerate(p):
        depth += (c in _OPEN) - (c in _SHUT)
        if c == ":" and depth == 0 and p[i + 1 : i + 2] != ":" and p[i - 1 : i] != ":":
            return i
    return -1


def normal_signature(head: str | None, name: str | None = None, lang: str | None = None) -> str | None:
    """The types of the parameters, in order and without blanks, names, defaults and modifiers, parted by commas: `*` where
    a parameter has no type. Receivers (self, cls, this, Go's) are left out. None if head has no whole parameter list."""
    got = parameters(head or "", name, lang)
    if got is None:
        return None
    out = []
    if not got:
        return ""
    if lang == "go":
        named = [re.match(r"([A-Za-z_]\w*)\s+(\S.*)$", p) for p in got]
        named = [m if m and m[1] not in GO_TYPES else None for m in named]
        if any(named):
            kind = ""
            for p, m in zip(reversed(got), reversed(named)):  # `a, b int`: names alone take the type that follows
                kind = _tight(m[2]) if m else kind or _tight(p)
                out.append(kind)
            return ",".join(reversed(out))
        return ",".join(_tight(p) for p in got)
    for k, p in enumerate(got):
        if _PLAIN.fullmatch(p) and lang != "java" and not (k == 0 and p in ("self", "cls")):
            out.append("*")
            continue
        p = re.sub(r"^(?:@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?\s*|#\[[^\]]*\]\s*)+", "", _unassigned(p))
        words = p.split()
        while words and words[0] in MODIFIERS and len(words) > 1:
            words.pop(0)
        p = " ".join(words)
        stars = re.match(r"\*{0,2}|\.{3}", p)[0] if lang == "python" else "..." if p.startswith("...") else ""
        if lang == "java":
            if re.search(r"(?:^|[\s.])this$", p):
                continue
            m = re.match(r"(.*?[\]>.\w])\s*?\b(\w+)((?:\s*\[\s*\])*)$", p)
            out.append(_tight(m[1]) + re.sub(r"\s", "", m[3]) if m and m[1].strip() else _tight(p) or "*")
            continue
        if lang == "python" and p in ("/", "*"):
            continue
        if k == 0 and lang == "python" and re.fullmatch(r"(?:self|cls)(?:\s*:.*)?", p) and "." in (name or "."):
            continue
        if lang == "rust" and re.fullmatch(r"(?:&\s*(?:'\w+\s+)?)?(?:mut\s+)?self(?:\s*:.*)?", p):
            continue
        if lang in ("typescript", "javascript") and re.match(r"this\s*:", p):
            continue
        at = _colon(p)
        kind = _tight(p[at + 1 :]) if at >= 0 else "*"
        out.append(stars + (re.sub("[\"']", "", kind) if lang == "python" else kind))
    return ",".join(out)


def module_of(path: str | None, lang: str | None) -> str:
    """What qualifies a name: the file without its ending, so that stubs and declaration files meet what they declare; for Go and
    Java, whose packages are directories, the directory."""
    path = path or ""
    if lang in ("go", "java"):
        return path.rpartition("/")[0]
    if lang in ("typescript", "javascript"):
        return re.sub(r"(?:\.d)?\.[mc]?[jt]sx?$", "", path)
    if lang == "python":
        return re.sub(r"/__init__$", "", re.sub(r"\.pyi?$", "", re.sub(r"-stubs(?=/)", "", path)))
    return re.sub(r"(?:/mod)?\.rs$", "", path)

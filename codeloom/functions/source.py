"""Symbols and calls of one source file: a tokenizer and a scan of nested scopes for languages with braces, the syntax tree for Python.

Pure Python, for use inside batches. Strings, comments, template and raw literals are tokens of their own, so brackets and words in
them don't count; brackets are matched once, and every declaration opens a scope that knows its class, function and caller.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from dataclasses import dataclass

_WORD = r"[A-Za-z_$ª-￿][\w$]*"
_COMMON = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)"
#: what the tokens of a language are: comments and blanks to skip, literals, words, marks (fixed values)
_TOKENS = {
    "script": re.compile(rf"(?P<skip>\s+|{_COMMON}|#![^\n]*)|(?P<lit>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|\d[\w.]*)|(?P<word>#?{_WORD})|(?P<mark>=>|\?\.(?!\d)|\.\.\.|[-+*/%&|^!=<>?:;,.@~()\[\]{{}}`\\])"),
    "go": re.compile(rf"(?P<skip>[ \t\r\f]+|{_COMMON})|(?P<lit>\"(?:[^\"\\\n]|\\.)*\"?|`[^`]*`?|'(?:[^'\\\n]|\\.)*'?|\d[\w.]*)|(?P<word>{_WORD})|(?P<mark>\n|\.\.\.|:=|<-|[-+*/%&|^!=<>?:;,.@~()\[\]{{}}])"),
    "rust": re.compile(rf"(?P<skip>\s+|//[^\n]*)|(?P<lit>b?r(?P<h>#*)\"(?:.|\n)*?\"(?P=h)|b?\"(?:[^\"\\]|\\.|\\\n)*\"?|b?'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x..|.))'|'[A-Za-z_]\w*|\d[\w.]*)|(?P<word>(?:r#)?{_WORD})|(?P<mark>::|->|=>|\.\.\.?|[-+*/%&|^!=<>?:;,.@~()\[\]{{}}#])"),
    "java": re.compile(rf"(?P<skip>\s+|{_COMMON})|(?P<lit>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*(?:\"\"\")?|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|\d[\w.]*)|(?P<word>{_WORD})|(?P<mark>->|::|\.\.\.|[-+*/%&|^!=<>?:;,.@~()\[\]{{}}])"),
}
FAMILY = {"typescript": "script", "tsx": "script", "javascript": "script", "go": "go", "rust": "rust", "java": "java"}
#: words that a bracket may follow without making a call (fixed values)
_KEYWORDS = {
    "script": {"if", "for", "while", "switch", "catch", "with", "function", "return", "typeof", "await", "yield", "in", "of", "instanceof", "new", "delete", "void", "case", "do", "else", "throw", "super", "import", "constructor", "async", "class", "extends"},
    "go": {"if", "for", "switch", "select", "func", "return", "go", "defer", "range", "case", "map", "chan", "struct", "interface", "type", "var", "const", "else"},
    "rust": {"if", "for", "while", "loop", "match", "fn", "return", "in", "let", "mut", "move", "ref", "as", "impl", "where", "unsafe", "else", "pub", "crate", "self", "Self", "dyn"},
    "java": {"if", "for", "while", "switch", "catch", "return", "synchronized", "new", "throw", "try", "else", "case", "assert", "super", "this", "do", "instanceof"},
}
_CONTROL = {"if", "for", "while", "switch", "catch", "with", "await", "return", "typeof", "function", "new", "super", "else", "do"}
#: marks and words after which an expression goes on, so that what follows is no statement of its own (fixed values)
_GOES_ON = {"=", "(", "[", ",", ":", "?", "=>", "+", "-", "*", "/", "%", "&", "|", "^", "!", "<", ">", ".", "?.", "..."} | {"return", "typeof", "new", "await", "yield", "in", "of", "throw", "case", "extends", "void", "delete"}
_JAVA_TYPES = {"class": "class", "interface": "interface", "enum": "class", "record": "class"}
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "strictfp", "transient", "volatile", "sealed"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    line: int
    match: int = -1


@dataclass(slots=True)
class Scope:
    """What a block knows of its place: the class that qualifies names, whether it lies in a function, and the caller of its calls."""

    owner: str | None = None
    in_function: bool = False
    caller: str | None = None
    skipped: bool = False
    members: bool = False


Symbol = tuple[str, str, str, int, int, str, str]  # key, name, kind, start_line, end_line, signature, content_hash
Call = tuple[str, str, int, str]  # caller_key, callee_name, line, confidence
Comment = tuple[int, int, str, bool]  # first and last line, text, whether it is a string of Python that documents
Rationale = tuple[str | None, str, str, int, str]  # symbol_key, kind, text, start_line, content_hash
#: tags of comments that give a reason, before a colon (fixed value)
_TAG = re.compile(r"(?i)(why|note|hack|todo|fixme):")
LEAST_DOCSTRING = 20
#: marks of a generated file, looked for in its first lines without case (fixed values)
_GENERATED, _HEAD_LINES = ("do not edit", "@generated", "code generated", "auto-generated"), 8


def tokens(text: str, family: str, comments: list[tuple[int, str]] | None = None) -> list[Token]:
    """The tokens of a text with their lines, brackets matched; nested comments of Rust, template strings and patterns of scripts are skipped whole.
    comments: gets (index, text) of each comment."""
    out: list[Token] = []
    find, i, n, line, counted = _TOKENS[family].match, 0, len(text), 1, 0
    opened: list[int] = []
    while i < n:
        if family == "rust" and text.startswith("/*", i):
            depth, j = 1, i + 2
            while j < n and depth:
                depth, j = (depth + 1, j + 2) if text.startswith("/*", j) else (depth - 1, j + 2) if text.startswith("*/", j) else (depth, j + 1)
            if comments is not None:
                comments.append((i, text[i:j]))
            i = j
            continue
        if family == "script" and text[i] == "`":
            end = _template(text, i)
            kind, value = "lit", "`"
        elif family == "script" and text[i] == "/" and text[i + 1 : i + 2] not in ("/", "*") and _opens_pattern(out) and (m := re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*").match(text, i)):
            end, kind, value = m.end(), "lit", "/"
        else:
            m = find(text, i)
            if not m:
                i += 1
                continue
            end, kind, value = m.end(), m.lastgroup if m.lastgroup != "h" else "lit", m[0]
            if kind == "skip":
                if comments is not None and value[0] == "/":
                    comments.append((i, value))
                i = end
                continue
        line += text.count("\n", counted, i)
        counted = i
        out.append(Token(kind, value, i, line))
        if kind == "mark":
            if value in "([{":
                opened.append(len(out) - 1)
            elif value in ")]}" and opened:
                out[-1].match = opened.pop()
                out[out[-1].match].match = len(out) - 1
        i = end
    return out


def _opens_pattern(out: list[Token]) -> bool:
    return not out or (out[-1].kind == "mark" and out[-1].text not in (")", "]", "}")) or (out[-1].kind == "word" and out[-1].text in _GOES_ON)


def _template(text: str, i: int) -> int:
    """Index after the template string that opens at i; what stands in ${} is skipped with it, template strings in there too."""
    i, n = i + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text[i + 1 : i + 2] == "{":
            depth, i = 1, i + 2
            while i < n and depth:
                if text[i] == "`":
                    i = _template(text, i)
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
        else:
            i += 1
    return n


class _Scan:
    def __init__(self, path: str, lang: str, text: str):
        self.path, self.text, self.family = path, text, FAMILY[lang]
        self.comments: list[tuple[int, str]] = []
        self.t = tokens(text, self.family, self.comments)
        self.symbols: list[tuple[int, Symbol]] = []
        self.calls: list[Call] = []
        self.opens: dict[int, Scope] = {}
        self.names: set[int] = set()  # tokens that name a declaration, which are no calls
        self.mute: list[tuple[int, int]] = []  # spans without calls: macros

    def word(self, i: int) -> str | None:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind == "word" else None

    def mark(self, i: int) -> str | None:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind == "mark" else None

    def declare(self, name: str, kind: str, first: int, last: int) -> str:
        a, z = self.t[first], self.t[min(last, len(self.t) - 1)]
        body = self.text[a.at : z.at + len(z.text)]
        head = body[:200].split("\n", 1)[0].strip()
        key = f"{self.path}#{name}"
        self.symbols.append((a.at, (key, name, kind, a.line, z.line, head, hashlib.sha256(body.encode("utf-8", "replace")).hexdigest())))
        return key

    def after_angles(self, i: int) -> int:
        """Index after the type parameters that open at i, or i."""
        if self.mark(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            c = self.mark(i)
            depth += (c == "<") - (c == ">")
            if c in ("(", "[", "{") and self.t[i].match > i:
                i = self.t[i].match
            elif depth == 0:
                return i + 1
            elif c == ";":
                return i
            i += 1
        return i

    def block_after(self, i: int, stop: str = ";") -> int:
        """Index of the brace that opens a body from i on, brackets skipped; -1 if a stop mark or the end comes first."""
        while i < len(self.t):
            c = self.mark(i)
            if c == "{":
                return i
            if c is not None and c in stop or c in (")", "]", "}"):
                return -1
            i = self.t[i].match + 1 if c in ("(", "[") and self.t[i].match > i else i + 1
        return -1

    def run(self) -> tuple[list[Symbol], list[Call]]:
        stack = [Scope(members=self.family == "java")]
        look = {"script": self.script, "go": self.go, "rust": self.rust, "java": self.java}[self.family]
        i = 0
        while i < len(self.t):
            token = self.t[i]
            if token.kind == "mark" and token.text == "{":
                here = stack[-1]
                stack.append(self.opens.get(i) or Scope(here.owner, here.in_function, here.caller, here.skipped))
            elif token.kind == "mark" and token.text == "}":
                if len(stack) > 1:
                    stack.pop()
            elif not stack[-1].skipped:
                if token.kind == "word":
                    look(i, stack[-1])
                    self.call(i, stack[-1])
            i += 1
        first: dict[str, Symbol] = {}
        for _, s in sorted(self.symbols, key=lambda x: x[0]):
            first.setdefault(s[0], s)  # the first of a key holds
        return list(first.values()), self.calls

    # ---- calls

    def call(self, i: int, scope: Scope) -> None:
        if scope.caller is None or i in self.names or any(a <= i <= z for a, z in self.mute[-1:]):
            return
        name = self.t[i].text
        if name in _KEYWORDS[self.family]:
            return
        j = i + 1
        if self.family == "rust" and self.mark(j) == "!" and self.mark(j + 1) in ("(", "[", "{"):
            self.mute.append((i, self.t[j + 1].match))  # what stands in a macro isn't parsed
            return
        if self.family == "rust" and self.mark(j) == "::" and self.mark(j + 1) == "<":
            j = self.after_angles(j + 1)
        elif self.family in ("script", "java") and self.mark(j) == "<":
            k = self.after_angles(j)
            j = k if self.mark(k) == "(" and (self.family == "java" or self.mark(k - 1) == ">") else j
        if self.family == "script" and self.mark(j) == "?." and self.mark(j + 1) == "(":
            j += 1
        if self.mark(j) != "(" or self.mark(i - 1) == "@":
            return
        begin, access = i, self.mark(i - 1) in (".", "?.", "::")
        while self.mark(begin - 1) in (".", "?.", "::"):  # to the beginning of the receiver
            k = begin - 2
            while k >= 0 and self.mark(k) in (")", "]") and 0 <= self.t[k].match < k:
                k = self.t[k].match - 1
            if k < 0 or self.t[k].kind == "mark":
                begin = max(k + 1, 0)
                break
            begin = k
        made = self.word(begin - 1) == "new"
        if self.family == "go" and self.word(begin - 1) == "func":
            return
        line = self.t[begin - 1].line if made else self.t[begin].line
        self.calls.append((scope.caller, name.removeprefix("r#"), line, "inferred" if access and not made else "extracted"))

    # ---- languages

    def statement(self, i: int) -> bool:
        """Whether a script's token begins a statement: nothing before it asks for an expression, or that stands on another line and is whole."""
        if i == 0:
            return True
        before = self.t[i - 1]
        if before.text in ("export", "default", "async", "declare", "abstract"):
            return self.statement(i - 1)
        if before.kind == "mark" and before.text in (";", "{", "}", ")"):
            return True
        return before.text not in _GOES_ON and before.line < self.t[i].line

    def begin(self, i: int, words: tuple[str, ...]) -> int:
        while self.word(i - 1) in words:
            i -= 1
        return i

    def script(self, i: int, scope: Scope) -> None:
        word = self.t[i].text
        if word == "function" and self.statement(i):
            j = i + 1 + (self.mark(i + 1) == "*")
            name = self.word(j)
            if not name or name == "(":
                return
            self.names.add(j)
            k = self.after_angles(j + 1)
            if self.mark(k) != "(" or self.t[k].match < 0:
                return
            body = self.typed_body(self.t[k].match + 1)
            if body < 0:
                return  # an overload's signature declares nothing
            key = self.declare(name, "function", self.begin(i, ("async", "export", "default", "declare")), self.t[body].match)
            exported = "export" in (self.word(i - 1), self.word(i - 2), self.word(i - 3))
            self.opens[body] = Scope(None if exported else scope.owner, True, key)
        elif word == "class" and self.word(i + 1) not in (None, "extends") and self.mark(i - 1) not in (".", "?."):
            body = self.block_after(i + 2)
            if body < 0:
                return
            name = self.word(i + 1)
            if scope.in_function:
                self.opens[body] = Scope(scope.owner, True, scope.caller, skipped=True)
            elif self.word(i - 1) == "abstract":
                self.opens[body] = Scope(scope.owner, scope.in_function, scope.caller, members=True)
            else:
                self.declare(name, "class", self.begin(i, ("export", "default", "declare")), self.t[body].match)
                self.opens[body] = Scope(name, False, scope.caller, members=True)
        elif word in ("const", "let", "var") and self.word(i - 1) == "export" and not scope.in_function:
            j, depth_end = i + 1, i + 1
            names = []
            while j < len(self.t):  # the names after the keyword and after each comma of the statement
                c = self.mark(j)
                if self.t[j].kind == "word" and self.t[j - 1].text in ("const", "let", "var", ",") and self.t[j].text != "enum":
                    names.append(self.t[j].text)
                if c in ("(", "[", "{") and self.t[j].match > j:
                    j = self.t[j].match
                elif c == ";":
                    depth_end = j
                    break
                elif j > i + 1 and self.t[j].line > self.t[j - 1].line and self.t[j - 1].text not in _GOES_ON and self.t[j].text not in _GOES_ON:
                    break
                depth_end = j
                j += 1
            for name in names:
                self.declare(name, "export", i - 1, depth_end)
        elif word not in _CONTROL and self.word(i - 1) not in ("function", "new", "case") and not (self.mark(i - 1) == "*" and self.word(i - 2) == "function"):
            k = self.after_angles(i + 1)
            if self.mark(k) != "(" or self.t[k].match < 0 or self.mark(i - 1) in (".", "?.", "@", "=>"):
                return
            body = self.typed_body(self.t[k].match + 1)
            if body < 0:
                return
            self.names.add(i)
            first = i
            while self.word(first - 1) in ("async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "accessor", "declare") or (self.mark(first - 1) == "*" and self.word(first - 2) != "function"):
                first -= 1
            key = self.declare(f"{scope.owner}.{word}" if scope.owner else word, "method", first, self.t[body].match)
            self.opens[body] = Scope(scope.owner, True, key)

    def typed_body(self, i: int) -> int:
        """The brace that opens a function's body after its parameters, a return type between them skipped; -1 if there is none."""
        if self.mark(i) == "{":
            return i
        if self.mark(i) != ":":
            return -1
        i += 1
        while i < len(self.t):
            c, before = self.mark(i), self.mark(i - 1)
            if c == "{":
                if before not in (":", "|", "&", "=>", ",", "<"):
                    return i
                i = self.t[i].match + 1 if self.t[i].match > i else i + 1
            elif c in (";", "=", "}", ")", "]", ","):
                return -1
            elif c in ("(", "[") and self.t[i].match > i:
                i = self.t[i].match + 1
            elif c == "<":
                i = max(self.after_angles(i), i + 1)
            else:
                i += 1
        return -1

    def go(self, i: int, scope: Scope) -> None:
        word = self.t[i].text
        if word == "func" and (i == 0 or self.mark(i - 1) in ("\n", ";", "}")):
            j, owner = i + 1, None
            if self.mark(j) == "(" and self.t[j].match > j:  # the receiver: its type, without pointer, package and type parameters
                inside = [k for k in range(j + 1, self.t[j].match) if self.t[k].kind == "word"]
                cut = next((k for k in range(j + 1, self.t[j].match) if self.mark(k) == "["), self.t[j].match)
                inside = [k for k in inside if k < cut]
                owner = self.t[inside[-1]].text if inside else None
                j = self.t[j].match + 1
            name = self.word(j)
            if not name:
                return
            self.names.add(j)
            k = j + 1
            if self.mark(k) == "[" and self.t[k].match > k:
                k = self.t[k].match + 1
            last = self.t[k].match if self.mark(k) == "(" and self.t[k].match > k else k
            body = last + 1
            while body < len(self.t) and self.mark(body) not in ("\n", "{", ";"):
                body = self.t[body].match + 1 if self.mark(body) in ("(", "[") and self.t[body].match > body else body + 1
            has = self.mark(body) == "{"
            end = self.t[body].match if has and self.t[body].match > body else body - 1
            key = self.declare(f"{owner}.{name}" if owner else name, "method" if owner else "function", i, end)
            if has:
                self.opens[body] = Scope(owner, True, key)
        elif word == "type" and not scope.in_function and (i == 0 or self.mark(i - 1) in ("\n", ";", "}")):
            if self.mark(i + 1) == "(":
                j, end = i + 2, self.t[i + 1].match
                while j < end:
                    if self.t[j].kind == "word" and self.mark(j - 1) in ("\n", "(", ";"):
                        self.go_type(j, j)
                    j = self.t[j].match + 1 if self.mark(j) in ("(", "[", "{") and self.t[j].match > j else j + 1
            else:
                self.go_type(i + 1, i)

    def go_type(self, i: int, first: int) -> None:
        name, j = self.word(i), i + 1
        if self.mark(j) == "[" and self.t[j].match > j and self.word(self.t[j].match + 1) in ("struct", "interface"):
            j = self.t[j].match + 1
        if self.mark(j) == "=":
            j += 1
        if name and self.word(j) in ("struct", "interface") and self.mark(j + 1) == "{":
            self.declare(name, "class" if self.word(j) == "struct" else "interface", first, self.t[j + 1].match)

    def rust(self, i: int, scope: Scope) -> None:
        word = self.t[i].text
        first = i
        while self.word(first - 1) in ("pub", "async", "unsafe", "const", "extern", "default") or (self.mark(first - 1) == ")" and self.t[first - 1].match > 0 and self.word(self.t[first - 1].match - 1) == "pub") or (self.t[first - 1].kind == "lit" and self.word(first - 2) == "extern" and first > 1):
            first = self.t[first - 1].match - 1 if self.mark(first - 1) == ")" else first - 1
        if word == "fn" and self.word(i + 1):
            self.names.add(i + 1)
            body = self.block_after(i + 2)
            if body < 0:
                return  # a trait's signature
            name = self.t[i + 1].text.removeprefix("r#")
            key = self.declare(f"{scope.owner}.{name}" if scope.owner else name, "method" if scope.owner else "function", first, self.t[body].match)
            self.opens[body] = Scope(scope.owner, True, key)
        elif word in ("struct", "enum", "trait") and self.word(i + 1) and self.mark(i - 1) not in (".", "::"):
            body = self.block_after(i + 2)
            if body >= 0:
                self.opens[body] = Scope(scope.owner, scope.in_function, None, skipped=True)
            if scope.in_function:
                return
            end = self.t[body].match if body >= 0 else next((k for k in range(i, len(self.t)) if self.mark(k) == ";"), i + 1)
            self.declare(self.t[i + 1].text, "interface" if word == "trait" else "class", first, end)
        elif word == "impl" and (i == 0 or self.mark(i - 1) in (";", "}", "{", "]") or self.word(i - 1) in ("unsafe", "default")):
            body = self.block_after(i + 1)
            if body < 0:
                return
            if scope.in_function:
                self.opens[body] = Scope(scope.owner, True, scope.caller, skipped=True)
                return
            j = self.after_angles(i + 1)
            name, k = None, j
            while k < body and self.word(k) != "where":
                if self.word(k) == "for":
                    name = None
                elif self.mark(k) == "<":
                    k = max(self.after_angles(k) - 1, k)
                elif self.t[k].kind == "word":
                    name = None if self.t[k].text in ("dyn",) or self.word(k - 1) == "dyn" else self.t[k].text
                k += 1
            self.opens[body] = Scope(name, False, scope.caller)
        elif word == "macro_rules" and self.mark(i + 1) == "!":
            body = self.block_after(i + 2)
            if body >= 0:
                self.opens[body] = Scope(skipped=True)

    def java(self, i: int, scope: Scope) -> None:
        word = self.t[i].text
        if word in _JAVA_TYPES and self.word(i + 1) and self.mark(i - 1) != ".":
            if word == "record" and self.mark(self.after_angles(i + 2)) != "(":
                return
            body = self.block_after(i + 2)
            if body < 0:
                return
            name = self.t[i + 1].text
            self.names.add(i + 1)
            if self.mark(i - 1) == "@":  # an annotation type
                self.opens[body] = Scope(scope.owner, scope.in_function, scope.caller)
            elif scope.in_function:
                self.opens[body] = Scope(scope.owner, True, scope.caller, skipped=True)
            else:
                self.declare(name, _JAVA_TYPES[word], self.java_first(i), self.t[body].match)
                self.opens[body] = Scope(name, False, scope.caller, members=True)
        elif self.mark(i + 1) == "(" and self.t[i + 1].match > i and i not in self.names and word not in _KEYWORDS["java"] and self.member(i, scope):
            close = self.t[i + 1].match
            k = close + 1
            while self.mark(k) in ("[", "]"):
                k += 1
            body = self.block_after(k) if self.mark(k) == "{" or self.word(k) in ("throws", "default") else -1
            end = self.t[body].match if body >= 0 else next((x for x in range(k, len(self.t)) if self.mark(x) == ";"), k)
            if body < 0 and self.mark(k) != ";" and self.word(k) not in ("throws", "default"):
                return
            self.names.add(i)
            key = self.declare(f"{scope.owner}.{word}" if scope.owner else word, "method", self.java_first(i), end)
            if body >= 0:
                self.opens[body] = Scope(scope.owner, True, key)
        elif word == "new" and self.word(i + 1):  # an anonymous class: its methods belong to the class around it
            k = i + 2
            while self.mark(k) == "." and self.word(k + 1):
                k += 2
            k = self.after_angles(k)
            if self.mark(k) == "(" and self.t[k].match > k and self.mark(self.t[k].match + 1) == "{":
                self.opens[self.t[k].match + 1] = Scope(scope.owner, scope.in_function, scope.caller, members=True)

    def member(self, i: int, scope: Scope) -> bool:
        """Whether a name before a bracket declares a member of the type around it: a type or, for a constructor, a modifier stands before it."""
        if not scope.members:
            return False
        before = self.t[i - 1]
        if before.kind == "word":
            return before.text not in _KEYWORDS["java"] and (before.text not in _MODIFIERS or self.t[i].text == scope.owner)
        if before.text == ">" or (before.text == "]" and self.mark(i - 2) == "["):
            return True
        return self.t[i].text == scope.owner and before.text in ("{", "}", ";", ")")

    def java_first(self, i: int) -> int:
        """The first token of a declaration: its modifiers and annotations count."""
        while i > 0 and not (self.t[i - 1].kind == "mark" and self.t[i - 1].text in ("{", "}", ";")):
            if self.mark(i - 1) == ")" and self.t[i - 1].match > 0:
                i = self.t[i - 1].match
            elif self.mark(i - 1) == "," and self.mark(i - 2) != ">" and not self.word(i - 2):
                break
            else:
                i -= 1
        return i


def _python(path: str, text: str) -> tuple[list[Symbol], list[Call], list[Comment]]:
    notes = _python_comments(text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _python_by_lines(path, text), [], notes
    lines = text.split("\n")
    found: list[Symbol] = []
    calls: list[Call] = []

    def declare(n, name: str, kind: str) -> str:
        key = f"{path}#{name}"
        body = [lines[n.lineno - 1][len(lines[n.lineno - 1].encode()[: n.col_offset].decode(errors="replace")) :], *lines[n.lineno : n.end_lineno]]
        found.append((key, name, kind, n.lineno, n.end_lineno, body[0][:200].strip(), hashlib.sha256("\n".join(body).encode("utf-8", "replace")).hexdigest()))
        return key

    todo: list = [(tree, None, False, None)]
    while todo:  # children go on the stack in reverse, so that the order is that of the text
        node, owner, inside, caller = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            caller = declare(node, f"{owner}.{node.name}" if owner else node.name, "method" if owner else "function")
            inside = True
        elif isinstance(node, ast.ClassDef):
            if inside:
                continue
            declare(node, node.name, "class")
            owner = node.name
        elif isinstance(node, ast.Call) and caller:
            f = node.func
            if isinstance(f, ast.Name):
                calls.append((caller, f.id, node.lineno, "extracted"))
            elif isinstance(f, ast.Attribute):
                calls.append((caller, f.attr, node.lineno, "inferred"))
        body = getattr(node, "body", None)
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
            notes.append((body[0].lineno, body[0].end_lineno, _segment(lines, body[0].value), True))
        todo += [(c, owner, inside, caller) for c in reversed(list(ast.iter_child_nodes(node)))]
    first: dict[str, Symbol] = {}
    for s in sorted(found, key=lambda s: s[3]):
        first.setdefault(s[0], s)
    return list(first.values()), calls, sorted(notes)


def _segment(lines: list[str], n: ast.AST) -> str:
    """The text of a node; its columns count bytes."""
    got = lines[n.lineno - 1 : n.end_lineno]
    got[-1] = got[-1].encode()[: n.end_col_offset].decode(errors="replace")
    got[0] = got[0].encode()[n.col_offset :].decode(errors="replace")
    return "\n".join(got)


def _python_comments(text: str) -> list[Comment]:
    out: list[Comment] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                out.append((t.start[0], t.start[0], t.string, False))
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass  # what was read before the fault counts
    return out


def _python_by_lines(path: str, text: str) -> list[Symbol]:
    """The declarations of a text that isn't valid Python, by their lines' indents."""
    lines = text.split("\n")
    bare = re.sub(r"\"{3}.*?\"{3}|'{3}.*?'{3}", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S).split("\n")
    heads = [(i, len(m[1].expandtabs()), m[2].endswith("class"), m[3]) for i, x in enumerate(bare) if (m := re.match(r"([ \t]*)((?:async\s+)?def|class)\s+([A-Za-z_]\w*)", x))]
    first: dict[str, Symbol] = {}
    around: list[tuple[int, bool, str]] = []
    for i, indent, is_class, name in heads:
        while around and around[-1][0] >= indent:
            around.pop()
        owner = next((n for _, c, n in reversed(around) if c), None)
        inside = any(not c for _, c, _ in around)
        around.append((indent, is_class, name))
        if is_class and inside:
            continue
        end = i
        for j in range(i + 1, len(bare)):
            if bare[j].strip() and len(bare[j]) - len(bare[j].lstrip()) <= indent and not bare[j].lstrip().startswith((")", "]", "}", "#")):
                break
            end = j if bare[j].strip() else end
        full = name if is_class or not owner else f"{owner}.{name}"
        key = f"{path}#{full}"
        body = "\n".join([lines[i].lstrip(), *lines[i + 1 : end + 1]])
        first.setdefault(key, (key, full, "class" if is_class else "method" if owner else "function", i + 1, end + 1, body.split("\n", 1)[0][:200].strip(), hashlib.sha256(body.encode("utf-8", "replace")).hexdigest()))
    return list(first.values())


def _plain_note(text: str, string: bool) -> str:
    """The text of a comment or documenting string without marks, quotes and line ends."""
    if string:
        text = re.sub(r"(?:\"{3}|'{3}|[\"'])$", "", re.sub(r"^[rubfRUBF]{0,3}(?:\"{3}|'{3}|[\"'])", "", text))
    elif text.startswith(("///", "//!")):
        text = text[3:]
    elif text.startswith("//"):
        text = text[2:]
    elif text.startswith("#"):
        text = text[1:]
    else:
        text = "\n".join(re.sub(r"^\s*\*+ ?", "", x) for x in re.sub(r"\*/$", "", re.sub(r"^/\*\*?", "", text)).split("\n"))
    return " ".join(text.split())


def _rationales(symbols: list[Symbol], notes: list[Comment], text: str) -> list[Rationale]:
    head = text.split("\n", _HEAD_LINES)[:_HEAD_LINES]
    if not notes or any(m in x.lower() for x in head for m in _GENERATED):
        return []
    last = [0] * len(notes)  # the last line of the run of comments, one right below the other, that each belongs to
    for k in range(len(notes) - 1, -1, -1):
        joined = k + 1 < len(notes) and notes[k + 1][0] == notes[k][1] + 1
        last[k] = last[k + 1] if joined else notes[k][1]
    begins: dict[int, str] = {}
    for s in symbols:
        begins.setdefault(s[3], s[0])
    out = []
    for (a, z, raw, string), end in zip(notes, last):
        plain = _plain_note(raw, string)
        if string or raw.startswith(("/**", "//!")) or (raw.startswith("///") and not raw.startswith("////")):
            if len(plain) < LEAST_DOCSTRING:
                continue
            kind = "docstring"
        elif m := _TAG.match(plain):
            kind = m[1].lower()
        else:
            continue
        around = [s for s in symbols if s[3] <= a and z <= s[4]]
        key = max(around, key=lambda s: (s[3], -s[4]))[0] if around else begins.get(end + 1)
        out.append((key, kind, plain, a, hashlib.sha256(plain.encode("utf-8", "replace")).hexdigest()))
    return out


def scan_source(path: str, lang: str | None, text: str | None) -> tuple[list[Symbol], list[Call], list[Rationale]]:
    """Symbols (key, name, kind, start_line, end_line, signature, content_hash), calls (caller_key, callee_name, line, confidence) and
    rationales (symbol_key, kind, text, start_line, content_hash) of a file.

    Names are `Class.method`; classes, types and implementations inside a function body declare nothing; the first of a key holds. Calls are those
    inside a function: `extracted` for a bare name or `new X()`, `inferred` for a member of something. Rationales are comments that open with
    a tag, and documentation of at least 20 characters; they belong to the innermost symbol around them, else to the one whose first
    line follows their run of comments, else to the file; a generated file has none. Line ends count as LF. Null, empty and foreign texts have nothing.
    """
    text = (text or "").removeprefix("\ufeff").replace("\r\n", "\n")
    if not text or (lang != "python" and lang not in FAMILY):
        return [], [], []
    if lang == "python":
        symbols, calls, notes = _python(path, text)
        return symbols, calls, _rationales(symbols, notes, text)
    scan = _Scan(path, lang, text)
    symbols, calls = scan.run()
    notes, line, counted = [], 1, 0
    for at, raw in scan.comments:
        line += text.count("\n", counted, at)
        counted = at
        notes.append((line, line + raw.count("\n"), raw, False))
    return symbols, calls, _rationales(symbols, notes, text)

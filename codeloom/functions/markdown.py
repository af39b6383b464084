"""Markdown pages: front matter, code masking, headings, anchors, links. A page is parsed once, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: markers inside pages (fixed formats)
ANCHORS = re.compile(r"<!--\s*lw:anchors\s+([\s\S]*?)-->")
MANUAL_START = re.compile(r"<!--\s*lw:manual:start\s*-->")
MANUAL_END = re.compile(r"<!--\s*lw:manual:end\s*-->")
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.M)
LINK = re.compile(r"\[([^\]\n]*)\]\(([^)\s]+)\)")


def slug(heading: str) -> str:
    h = "".join(c for c in unicodedata.normalize("NFD", heading.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(r"\s+", "-", re.sub(r"[^A-Za-z0-9_\s-]", "", h).strip())


def mask_code(text: str) -> str:
    """The text at its old length with fenced blocks and code spans blanked; line ends stay."""
    out, pos, fence = [], 0, None
    for line in text.splitlines(keepends=True):
        bare = line.lstrip(" ")
        indent = len(line) - len(bare)
        m = re.match(r"(`{3,}|~{3,})", bare) if indent <= 3 else None
        if fence is None and m and not (m[1][0] == "`" and "`" in bare[len(m[1]) :]):
            fence = m[1]
            out.append(_blank(line))
        elif fence is not None:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not bare[len(m[1]) :].strip():
                fence = None
            out.append(_blank(line))
        else:
            out.append(line)
        pos += len(line)
    return _mask_spans("".join(out))


def _blank(s: str) -> str:
    return re.sub(r"[^\r\n]", " ", s)


def _mask_spans(text: str) -> str:
    runs = list(re.finditer(r"`+", text))
    out, at, i = [], 0, 0
    while i < len(runs):
        size = len(runs[i][0])
        close = next((j for j in range(i + 1, len(runs)) if len(runs[j][0]) == size and "\n\n" not in text[runs[i].end() : runs[j].start()]), None)
        if close is None:
            i += 1
            continue
        out += [text[at : runs[i].start()], _blank(text[runs[i].start() : runs[close].end()])]
        at = runs[close].end()
        i = close + 1
    return "".join(out) + text[at:]


def open_fence(text: str) -> bool:
    """Whether a fenced block is never closed."""
    fence = None
    for line in text.splitlines():
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        if m and fence is None:
            fence = m[1]
        elif m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
            fence = None
    return fence is not None


def front_matter(text: str) -> tuple[dict[str, list[str]], int, str | None]:
    """(values by key, offset of the body, error). Values are strings or lists of strings; a text without a head has none."""
    m = re.match(r"---[ \t]*\r?\n", text)
    if not m:
        return {}, 0, None
    end = re.compile(r"^---[ \t]*(?:\r?\n|$)", re.M).search(text, m.end())
    if not end:
        return {}, 0, "unclosed front matter"
    out: dict[str, list[str]] = {}
    key = None
    for line in text[m.end() : end.start()].splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = re.match(r"\s+-\s+(.*)$|-\s+(.*)$", line)
        pair = re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", line)
        if item and key is not None:
            out[key].append((item[1] or item[2] or "").strip().strip("\"'"))
        elif pair:
            key = pair[1]
            v = pair[2].strip()
            if v.startswith("[") and v.endswith("]"):
                out[key] = [x.strip().strip("\"'") for x in v[1:-1].split(",") if x.strip()]
            else:
                out[key] = [v.strip("\"'")] if v else []
        else:
            return {}, end.end(), f"line not understood: {line.strip()[:80]}"
    return out, end.end(), None


def split_sections(text: str, level: int = 2) -> list[tuple[str, int, int]]:
    """(heading, start, end) of the sections of a level; headings in code don't count. What stands before the first is named ``."""
    heads = [(m.start(), m[2]) for m in HEADING.finditer(mask_code(text)) if len(m[1]) == level]
    marks = [(0, "")] * (not heads or heads[0][0] > 0) + heads
    return [(name, at, marks[k + 1][0] if k + 1 < len(marks) else len(text)) for k, (at, name) in enumerate(marks)]


def splice_section(text: str, heading: str, body: str) -> str:
    """The text with the first section of that heading replaced; a heading that isn't there changes nothing."""
    for name, a, z in split_sections(text):
        if name == heading:
            return text[:a] + body + text[z:]
    return text


def purpose(text: str) -> str | None:
    """The first paragraph of prose of a page, None if there is none."""
    body = text[front_matter(text)[1] :]
    for block in re.split(r"\n\s*\n", mask_code(body)):
        s = " ".join(block.split())
        if s and not s.startswith(("#", ">", "<!--", "- ", "* ", "|", "![")):
            return s
    return None


def parse(text: str) -> dict:
    """Everything the operators ask of a page."""
    head, at, error = front_matter(text)
    body = text[at:]
    masked = mask_code(body)
    headings = [(len(m[1]), m[2], slug(m[2]), m.start()) for m in HEADING.finditer(masked)]
    blocks, start = [], None
    events = sorted([(m.start(), True) for m in MANUAL_START.finditer(body)] + [(m.start(), False) for m in MANUAL_END.finditer(body)])
    for offset, opens in events:
        if opens and start is None:
            start = offset
        elif not opens and start is not None:
            blocks.append((start, offset))
            start = None
    sections = []
    for m in ANCHORS.finditer(masked):
        before = [h for h in headings if h[3] < m.start()]
        if before:
            inside = any(a <= m.start() and m.end() <= b for a, b in blocks)
            sections.append((before[-1][2], before[-1][1], m[1].split(), m.start() + at, inside))
    return {
        "owner": (head.get("owner") or [None])[0],
        "title": (head.get("title") or [None])[0],
        "page_anchors": head.get("anchors") or [],
        "section_anchors": sections,
        "headings": [(level, t, s, o + at) for level, t, s, o in headings],
        "all_slugs": [slug(m[2]) for m in HEADING.finditer(body)],
        "links": [(m[1], m[2], m.start() + at) for m in LINK.finditer(masked)],
        "manual_blocks": [(a + at, b + at, text[a + at : b + at]) for a, b in blocks],
        "think_block": bool(re.search(r"(?i)</?think(?:ing)?>", masked)),
        "open_fence": open_fence(body),
        "error": error,
    }


PAGE = (
    "owner string, title string, page_anchors array<string>, section_anchors array<struct<section_slug:string,heading_text:string,symbol_keys:array<string>,anchor_marker_offset:int,in_manual_block:boolean>>, "
    "headings array<struct<level:int,text:string,slug:string,offset:int>>, all_slugs array<string>, links array<struct<text:string,target:string,offset:int>>, "
    "manual_blocks array<struct<start_offset:int,end_offset:int,text:string>>, think_block boolean, open_fence boolean, error string"
)


def parse_pages(pages: DataFrame, path: str = "wiki_path", text: str = "text") -> DataFrame:
    """wiki_path and what a page holds, as columns of PAGE. Pages without text give none; a head that can't be read gives an error."""
    src = pages.select(F.col(path).alias("wiki_path"), F.col(text).alias("text")).where("text is not null and wiki_path is not null")

    def run(batches):
        for b in batches:
            rows = [parse(t) for t in b["text"]]
            columns = [x.strip().split(" ")[0] for x in re.split(r",\s+(?=[a-z_]+ [a-z])", PAGE)]
            out = pd.DataFrame({c: [_plain(r[c], c) for r in rows] for c in columns})
            out.insert(0, "wiki_path", b["wiki_path"].to_numpy())
            yield out

    return src.mapInPandas(run, "wiki_path string, " + PAGE)


_FIELDS = {
    "section_anchors": ("section_slug", "heading_text", "symbol_keys", "anchor_marker_offset", "in_manual_block"),
    "headings": ("level", "text", "slug", "offset"),
    "links": ("text", "target", "offset"),
    "manual_blocks": ("start_offset", "end_offset", "text"),
}


def _plain(value, column: str):
    return [dict(zip(_FIELDS[column], v)) for v in value] if column in _FIELDS else value

"""Column expressions for texts: hashes, identifiers, slugs, excerpts, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: signals of a topic, each with the pattern that its text in lower case shows (fixed values)
TOPIC_SIGNALS = {
    "configuration": r"config|preset|provider|setting|option|environment",
    "persistence/state": r"database|\bdb\b|persist|storage|store|cache|checkpoint|state",
    "validation/recovery": r"validat|verif|schema|guard|safety|rollback|recover|error",
    "output": r"output|export|render|write|emit|response|artifact",
    "entry/boundary": r"command|cli|route|handler|server|entry",
}


def normalize_eol(c: Column) -> Column:
    """CR LF as LF; a lone CR stays."""
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def expand_eol(c: Column) -> Column:
    return F.replace(normalize_eol(c), F.lit("\n"), F.lit("\r\n"))


def content_digest(c: Column) -> Column:
    """SHA-256 of a text with its line ends normalised."""
    return F.sha2(normalize_eol(c), 256)


def split_identifiers(c: Column) -> Column:
    """Every identifier of several parts is followed by its parts: `fooBar` gives `fooBar foo Bar`; other words stay."""
    words = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), 0)

    def part(w: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(w, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
        parts = F.filter(F.split(spaced, "[_ ]+"), lambda x: x != "")
        return F.when(w.rlike("^[A-Za-z0-9_]") & (F.size(parts) > 1), F.concat_ws(" ", F.array(w), parts)).otherwise(w)

    return F.array_join(F.transform(words, part), "")


@F.pandas_udf(T.StringType())
def slugify(s: pd.Series) -> pd.Series:
    """Heading to slug: lower case, without accents and punctuation, blanks as hyphens. Python, as no built-in decomposes accents."""
    import re
    import unicodedata

    def slug(x):
        if x is None:
            return None
        x = "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not 0x300 <= ord(c) <= 0x36F)
        return re.sub(r"\s+", "-", re.sub(r"[^A-Za-z0-9_\s-]", "", x).strip())

    return s.map(slug)


def ascii_slug(c: Column) -> Column:
    """The slug of a heading of ASCII letters, without Python."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s-]", "")), r"\s+", "-")


def module_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normal_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def plain_excerpt(c: Column, cap: int = 400) -> Column:
    """The first `cap` characters of a page's prose, without code spans, comments, headings and mark-up."""
    t = F.regexp_replace(c, r"(?s)```.*?```|~~~.*?~~~", " ")
    t = F.regexp_replace(t, r"`[^`\n]*`", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?m)^#{1,6}\s+.*$", " ")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\(([^)]*)\)", "$1")
    t = F.regexp_replace(t, r"[#>*_`|-]+", " ")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, cap)


def snippet_around(c: Column, term: Column | str, side: int = 80) -> Column:
    """The first match of a term in << >> with `side` characters around it; without a match the first 160 characters."""
    t = F.lower(term if isinstance(term, Column) else F.lit(term))
    at = F.position(t, F.lower(c))
    start = F.greatest(at - side, F.lit(1))
    end = F.least(at + F.length(t) + side, F.length(c) + 1)
    found = F.concat(
        F.when(start > 1, "...").otherwise(""),
        F.substring(c, start, at - start),
        F.lit("<<"), F.substring(c, at, F.length(t)), F.lit(">>"),
        F.substring(c, at + F.length(t), end - at - F.length(t)),
        F.when(end <= F.length(c), "...").otherwise(""),
    )
    head = F.concat(F.rtrim(F.substring(c, 1, 160)), F.when(F.length(c) > 160, "...").otherwise(""))
    return F.when(at > 0, found).otherwise(head)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / F.lit(4))


def output_budget(chars: Column, items: Column, base: int, per_item: int, least: int, most: int) -> Column:
    """base + per_item * items + a fortieth of the characters, rounded up to 256 and kept within bounds."""
    raw = F.lit(base) + F.lit(per_item) * items + F.ceil(chars / F.lit(40))
    return F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(raw / F.lit(256)) * 256)).cast("long")


def signature_line(c: Column) -> Column:
    """The first line that is not blank, at most 200 characters of it."""
    return F.substring(F.regexp_extract(c, r"(?m)^[ \t]*(\S.*?)[ \t\r]*$", 1), 1, 200)


def rationale_text(c: Column) -> Column:
    """A comment's text without its marks, blanks as one."""
    t = F.regexp_replace(c, r"^\s*(///|//!|//|#|/\*\*?)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\*/\s*$", ""), r"(?m)^\s*\*+ ?", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def topic_signals(c: Column) -> Column:
    """The signals that a text shows, as an array in their fixed order."""
    return F.array_compact(F.array(*[F.when(F.lower(c).rlike(p), name) for name, p in TOPIC_SIGNALS.items()]))


def symbol_snippet(content: Column, start: Column, end: Column, around: int = 3) -> Column:
    """The lines of a symbol with `around` lines on either side."""
    lines = F.split(content, "\n")
    first = F.greatest(start - around, F.lit(1))
    count = F.least(end + around, F.size(lines)) - first + 1
    return F.when((start >= 1) & (start <= F.size(lines)) & (end >= start), F.array_join(F.slice(lines, first, count), "\n"))


def week_start(ts: Column) -> Column:
    """The UTC Monday of a timestamp as a date."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))
    return F.date_trunc("week", day.cast("timestamp_ntz")).cast("date")


def round_half_up(c: Column, places: int = 1) -> Column:
    scale = 10**places
    return F.floor(c * scale + 0.5) / scale


def bands(c: Column, steps: list[tuple[int, int]]) -> Column:
    """Points of the highest band whose least value c reaches; steps: (least value, points), 0 below all."""
    out = F.lit(0)
    for least, points in sorted(steps):
        out = F.when(c >= least, points).otherwise(out)
    return out

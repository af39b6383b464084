"""Column expressions for symbol keys, content hashes, states and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: blanks that may surround a value, as a Java character class (fixed values)
BLANKS = r"[\s\u0085   -​    　﻿]+"

_ENDS = BLANKS.rstrip("+").replace("[", "[./", 1)


def trimmed(c: Column) -> Column:
    """c without any kind of blank at its ends."""
    return F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", "")


def normal_path(path: Column) -> Column:
    """One spelling of a relative path: forward slashes, no empty or dot segments, `..` resolved where it can be."""
    slashed = F.regexp_replace(path, r"\\", "/")
    segments = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(
            (s == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return F.concat_ws("/", folded)


def normal_key(key: Column) -> Column:
    """The spelling of a symbol key `path#name` that symbols.key uses; null for a null or blank key.

    Blanks around the key go, the path part gets its normal spelling. Letter case and all else stay.
    A key in normal spelling is recognised by plain searches and passes unchanged.
    """
    k = trimmed(key)
    at = F.instr(k, "#")
    path = F.when(at > 0, F.substring_index(k, "#", 1)).otherwise(k)
    name = F.substring(k, at, F.length(k))
    respelled = F.when(at > 0, F.concat(normal_path(path), name)).otherwise(normal_path(path))
    # plain searches tell the few keys that need work: a blank, dot or slash at an end, a backslash, an empty or dot segment
    ends = F.concat(F.substring(key, 1, 1), F.substring(key, -1, 1))
    odd = ends.rlike(_ENDS) | F.contains(key, F.lit("\\")) | F.contains(key, F.lit("//")) | F.contains(key, F.lit("/."))
    out = F.when(odd, respelled).otherwise(key)
    return F.when(out != "", out)


def normal_hash(h: Column) -> Column:
    """A content hash without blanks, letter case and the label of its kind (`sha256:`)."""
    return F.regexp_replace(F.lower(trimmed(h)), r"^[a-z][a-z0-9_-]*\s*[:=]\s*", "")


def normal_word(c: Column) -> Column:
    """A state or label without blanks and letter case."""
    return F.lower(trimmed(c))


def utc_month(ts: Column) -> Column:
    """`YYYY-MM` of a timestamp in UTC, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))
    return F.date_format(day, "yyyy-MM")

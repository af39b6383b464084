"""Identifier-aware full-text search: an inverted index with positions, boolean queries, BM25."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import snippet_around, split_identifiers

K1, B = 1.2, 0.75


BUCKETS = 256


def _bucket(term):
    """The bucket of a term in a stored index, by its first two characters, so that a prefix of two or more has one bucket too."""
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(BUCKETS)).cast("int")


def inverted_index(docs: DataFrame, id: str, text: str, identifiers: bool = False) -> DataFrame:
    """doc, term, positions, tf, doc_len: one row per term of a document. With identifiers, parts of identifiers are terms too."""
    body = split_identifiers(F.col(text)) if identifiers else F.col(text)
    words = F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}_]+"), 0)
    d = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("doc"), words.alias("w")).withColumn("doc_len", F.size("w"))
    rows = d.select("doc", "doc_len", F.posexplode("w").alias("pos", "term"))
    return rows.groupBy("term", "doc", "doc_len").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.count(F.lit(1)).alias("tf"))


def index_sizes(index: DataFrame) -> DataFrame:
    """One row: n_docs and avg_len of an index. A stored index keeps it, as it takes a pass over all rows."""
    return index.select("doc", "doc_len").distinct().agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def store_index(index: DataFrame, folder: str) -> None:
    """Writes an index, in folders by bucket of the term and sorted by term in them, and its sizes beside it."""
    rows = index.withColumn("bucket", _bucket(F.col("term")))
    rows.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(16))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    stored, _ = load_index(rows.sparkSession, folder, sized=False)
    index_sizes(stored).write.mode("overwrite").parquet(f"{folder}/sizes")


def load_index(spark, folder: str, sized: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """A stored index and its sizes, for match: a query reads the folders of its own terms' buckets only."""
    return spark.read.parquet(f"{folder}/terms"), spark.read.parquet(f"{folder}/sizes") if sized else None


class QueryError(ValueError):
    """A query that can't be read."""


#: a query as a tree: ("or" | "and" | "not", left, right) or ("part", kind, words), kind being `term`, `prefix` (word*) or `phrase` ("a b")
Query = tuple


def parse_query(query: str) -> Query:
    """The tree of a query: OR binds least, then AND, then NOT (without), then parts side by side (all of them); brackets group."""
    tokens = re.findall(r'"[^"]*"|[^\s"()]+|[()"]', query)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def level(words: list[str], below) -> Query:
        nonlocal at
        left = below()
        while peek() == words[0]:
            at += 1
            left = (words[0].lower(), left, below())
        return left

    def primary() -> Query:
        nonlocal at
        t = peek()
        if t is None:
            raise QueryError("nothing to search for")
        at += 1
        if t == "(":
            inner = either()
            if peek() != ")":
                raise QueryError("a bracket isn't closed")
            at += 1
            return inner
        if t in ("OR", "AND", "NOT", ")", '"'):
            raise QueryError(f"not understood: {t}")
        words = re.findall(r"\w+", t.lower())
        if not words or "*" in t[:-1]:
            raise QueryError(f"not understood: {t}")
        kind = "phrase" if t.startswith('"') else "prefix" if t.endswith("*") else "term" if len(words) == 1 else "phrase"
        return ("part", kind, words)

    def beside() -> Query:
        left = primary()
        while peek() not in (None, "OR", "AND", "NOT", ")"):
            left = ("and", left, primary())
        return left

    def without() -> Query:
        return level(["NOT"], beside)

    def both() -> Query:
        return level(["AND"], without)

    def either() -> Query:
        return level(["OR"], both)

    tree = either()
    if at < len(tokens):
        raise QueryError(f"not understood: {tokens[at]}")
    return tree


def match(index: DataFrame, query: str, sizes: DataFrame | None = None) -> DataFrame:
    """doc, score of the documents that a query matches, by BM25 over its parts. A query that can't be read matches nothing.

    Of a stored index only the folders of the query's own terms are read, and with sizes, as load_index gives them, no other
    row; an index made on the spot is made as a whole, and without sizes it is read once more for them.
    """
    try:
        tree = parse_query(query)
    except QueryError:
        return index.select("doc").limit(0).withColumn("score", F.lit(0.0))
    stored = "bucket" in index.columns
    sizes = (index_sizes(index) if sizes is None else sizes).withColumn("one", F.lit(1))

    def rows(word: str, prefix: bool = False) -> DataFrame:
        hit = F.col("term").startswith(word) if prefix else F.col("term") == word
        return index.where((F.col("bucket") == _bucket(F.lit(word))) & hit) if stored and not (prefix and len(word) < 2) else index.where(hit)

    parts: list[DataFrame] = []

    def leaf(kind: str, words: list[str]) -> int:
        if kind == "phrase" and len(words) > 1:
            h = rows(words[0]).select("doc", "doc_len", F.explode("positions").alias("p"))
            for i, w in enumerate(words[1:], 1):
                h = h.join(rows(w).select("doc", F.explode("positions").alias("p0")).select("doc", (F.col("p0") - i).alias("p")), ["doc", "p"])
            h = h.groupBy("doc", "doc_len").agg(F.count(F.lit(1)).alias("tf"))
        else:
            h = rows(words[0], kind == "prefix").groupBy("doc", "doc_len").agg(F.sum("tf").alias("tf"))
        parts.append(h.select("doc", "doc_len", "tf", F.lit(len(parts)).alias("part")))
        return len(parts) - 1

    def holds(node: Query):
        if node[0] == "part":
            return F.max(F.col("part") == leaf(*node[1:]))
        left, right = holds(node[1]), holds(node[2])
        return left | right if node[0] == "or" else left & right if node[0] == "and" else left & ~right

    condition = holds(tree)
    hits = reduce(DataFrame.unionByName, parts)
    df = hits.groupBy("part").agg(F.count_distinct("doc").alias("df"))
    full = hits.groupBy("doc").agg(condition.alias("holds")).where("holds").select("doc")
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    scored = hits.join(full, "doc", "left_semi").join(F.broadcast(df), "part").withColumn("one", F.lit(1)).join(F.broadcast(sizes), "one")  # df: a row per part of the query
    return scored.groupBy("doc").agg(F.sum(idf * weight).alias("score"))


def search(docs: DataFrame, query: str, id: str = "wiki_path", text: str = "text", limit: int = 20, folder: str | None = None) -> DataFrame:
    """rank, doc, source, snippet: hits of the plain index first, best first, then those that only the index of split identifiers has.
    folder: where store_indexes has put both; without it they are made for this query."""
    spark = docs.sparkSession
    plain, parted = (load_index(spark, f"{folder}/{n}") if folder else (inverted_index(docs, id, text, identifiers=n == "split"), None) for n in ("plain", "split"))
    raw = match(plain[0], query, plain[1]).withColumn("source", F.lit(0))
    split = match(parted[0], query, parted[1]).withColumn("source", F.lit(1))
    best = raw.unionByName(split).groupBy("doc").agg(F.min(F.struct("source", (-F.col("score")).alias("s"))).alias("m"))
    top = best.select("doc", F.col("m.source").alias("source"), F.col("m.s").alias("s")).orderBy("source", F.round("s", 9), "doc").limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("source", F.round("s", 9), "doc")))
    first = (re.findall(r"\w+", query) or [""])[0]
    return ranked.join(docs.select(F.col(id).alias("doc"), text), "doc").select("rank", "doc", F.when(F.col("source") == 0, "plain").otherwise("split").alias("source"), snippet_around(F.col(text), F.lit(first)).alias("snippet"))


def store_indexes(docs: DataFrame, folder: str, id: str = "wiki_path", text: str = "text") -> None:
    """Writes both indexes that search reads."""
    for name in ("plain", "split"):
        store_index(inverted_index(docs, id, text, identifiers=name == "split"), f"{folder}/{name}")


def upsert(index: DataFrame, changed: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The index with the documents of `changed` (an index of them) in place of their old rows, and without those of `gone` (doc)."""
    out = index.join(changed.select("doc").distinct(), "doc", "left_anti").unionByName(changed)
    return out if gone is None else out.join(gone.select("doc"), "doc", "left_anti")


def quick_find(docs: DataFrame, needle: str, title: str, text: str, limit: int = 50) -> DataFrame:
    """Documents that hold a string, hits in the title first, then by title."""
    n = needle.lower()
    inside = F.contains(F.lower(F.col(title)), F.lit(n))
    found = docs.where(inside | F.contains(F.lower(F.col(text)), F.lit(n)))
    return found.withColumn("in_title", F.coalesce(inside, F.lit(False))).orderBy(F.desc("in_title"), title).limit(limit)

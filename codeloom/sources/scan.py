"""Walking a repository and reading symbols, calls and intent comments out of its files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.keys import normal_path
from codeloom.functions.paths import DEFAULT_IGNORES, denied, language
from codeloom.functions.source import scan_source
from codeloom.functions.text import content_digest, rationale_text

LARGEST, SNIFF = 1 << 20, 8192
#: tags of comments that give a reason (fixed values)
TAGS = ("why", "note", "hack", "todo", "fixme")


def walk(spark: SparkSession, root: str, ignores: list[str] = DEFAULT_IGNORES) -> DataFrame:
    """path, lang, size, mtime, content of the text files under a folder that a walk keeps, read as binary files in parallel. What the
    folder's own .gitignore names is left out too."""
    prefix = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    ignores = [*ignores, *ignore_file(spark, root)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.substring_index(F.regexp_replace("path", "^file:/*", "/"), prefix, -1)
    return keep_readable(files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content"), ignores)


def ignore_file(spark: SparkSession, root: str) -> list[str]:
    """The patterns of a folder's .gitignore, none if it has no such file. Negations, comments and empty lines are no patterns."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/.gitignore")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    source = fs.open(path)  # one settings file, which file sources pass over as hidden
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    return [x.strip() for x in text.splitlines() if x.strip() and not x.startswith(("#", "!"))]


def keep_readable(files: DataFrame, ignores: list[str] = DEFAULT_IGNORES) -> DataFrame:
    """Of path, size, mtime, content (binary) the files that are kept: allowed by name, not over 1 MiB, without NUL in the first 8 KiB."""
    text = files.where(denied(F.col("path"), ignores).isNull() & (F.col("size") <= LARGEST))
    binary = F.instr(F.hex(F.substring("content", 1, SNIFF)), "00") > 0
    nul = F.regexp_count(F.hex(F.substring("content", 1, SNIFF)), F.lit("^(?:[0-9A-F]{2})*?00")) > 0
    return text.where(~(binary & nul)).select(normal_path(F.col("path")).alias("path"), language(F.col("path")).alias("lang"), "size", "mtime", F.decode("content", "UTF-8").alias("content"))


def scan_reasons(files: DataFrame, contents: DataFrame, ignores: list[str] = DEFAULT_IGNORES) -> DataFrame:
    """file_id, verdict: `kept`, or why a file with content isn't read: its name, `too large`, `binary`. files: id, path; contents: file_id, content."""
    j = contents.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    verdict = F.coalesce(
        denied(F.col("path"), ignores),
        F.when(F.octet_length("content") > LARGEST, "too large"),
        F.when(F.instr(F.substring("content", 1, SNIFF), "\0") > 0, "binary"),
        F.lit("kept"),
    )
    return j.select("file_id", verdict.alias("verdict"))


def snapshot_digest(files: DataFrame, contents: DataFrame) -> DataFrame:
    """repo, digest: SHA-256 over path and content hash of a repository's files, in order of path."""
    j = contents.join(files.where("status = 'active'").select(F.col("id").alias("file_id"), "path"), "file_id")
    line = F.concat("path", F.lit("\n"), content_digest(F.col("content")), F.lit("\n"))
    rows = j.select(F.substring_index("path", "/", 2).alias("repo"), "path", line.alias("line"))
    lines = rows.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("path", "line"))).alias("l"))
    return lines.select("repo", F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), ""), 256).alias("digest"))


SYMBOL_FIELDS = {"key": "string", "name": "string", "kind": "string", "start_line": "int", "end_line": "int", "signature": "string", "content_hash": "string"}
CALL_FIELDS = {"caller_key": "string", "callee_name": "string", "line": "int", "confidence": "string"}
RATIONALE_FIELDS = {"symbol_key": "string", "kind": "string", "text": "string", "start_line": "int", "content_hash": "string"}


_ARROW = {"string": pa.string(), "int": pa.int32()}


def _nested(rows: list[list[tuple]], fields: dict[str, str]) -> pa.Array:
    """A list of structs per row, from tuples, column by column."""
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    columns = list(zip(*[x for r in rows for x in r])) or [() for _ in fields]
    values = pa.StructArray.from_arrays([pa.array(list(c), _ARROW[t]) for c, t in zip(columns, fields.values())], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def parse_files(files: DataFrame) -> DataFrame:
    """path and symbols, calls, rationales as arrays of structs for files with path, lang, content, see source.scan_source; only changed
    files need be given. One pass over the texts in Arrow batches, without a shuffle."""
    kinds = {"symbols": SYMBOL_FIELDS, "calls": CALL_FIELDS, "rationales": RATIONALE_FIELDS}
    schema = "path string, " + ", ".join(f"{n} array<struct<{','.join(f'{k}:{t}' for k, t in fields.items())}>>" for n, fields in kinds.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # small results, as texts may be very long
                b = whole.slice(at, 256)
                got = [scan_source(path or "", lang, text) for path, lang, text in zip(*(b.column(c).to_pylist() for c in ("path", "lang", "content")))]
                yield pa.RecordBatch.from_arrays([b.column("path"), *(_nested([g[k] for g in got], f) for k, f in enumerate(kinds.values()))], names=["path", *kinds])

    return files.select("path", "lang", "content").mapInArrow(run, schema)


def rationales(contents: DataFrame, least: int = 20) -> DataFrame:
    """file_id, kind, line, text, content_hash of comment lines that open with a tag and say at least `least` characters."""
    lines = contents.select("file_id", F.posexplode(F.split("content", "\n")).alias("at", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^[ \t]*(?://+|#+|/\*+|\*)[ \t]*(?i)(why|note|hack|todo|fixme)\b", 1))
    body = F.regexp_replace(rationale_text(F.col("raw")), r"^(?i)(why|note|hack|todo|fixme)\b[:\s-]*", "")
    return lines.select("file_id", tag.alias("kind"), (F.col("at") + 1).alias("line"), body.alias("text")).where((F.col("kind") != "") & (F.length("text") >= least)).withColumn("content_hash", F.sha2("text", 256))


def comment_blocks(lines: DataFrame) -> DataFrame:
    """file_id, start_line, end_line of runs of consecutive lines: gaps and islands. lines: file_id, line."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("line")
    n = lines.select("file_id", "line").distinct().withColumn("island", F.col("line") - F.row_number().over(w))
    return n.groupBy("file_id", "island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("island")

"""Writing results: whole snapshots, merged tables, exports, and a guard against two writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import page_group
from codeloom.functions.text import plain_excerpt


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def write_snapshot(df: DataFrame, folder: str) -> str:
    """Writes a table as a new version beside the old ones and returns its path; readers see whole versions only."""
    path = f"{folder}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def publish(spark: SparkSession, folder: str, version: str, expected: str | None) -> bool:
    """Makes a version current if `expected` still is; False if another writer was first. The pointer is a new file, written beside and renamed
    without overwriting, so that readers see it whole or not at all; faults other than a lost race are raised."""
    fs, _ = _fs(spark, folder)
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    if current(spark, folder) != expected:
        return False
    n = len([s for s in fs.listStatus(make(folder)) if s.getPath().getName().startswith("current-")]) if fs.exists(make(folder)) else 0
    draft, pointer = make(f"{folder}/.draft-{uuid.uuid4().hex}"), make(f"{folder}/current-{n:08d}")
    out = fs.create(draft, False)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, pointer, options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def update(spark: SparkSession, folder: str, make: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> str:
    """Writes make(current table or None) as the next version; if another writer was first, it is made anew from theirs, `tries` times at most."""
    for _ in range(tries):
        expected = current(spark, folder)
        version = write_snapshot(make(spark.read.parquet(expected) if expected else None), folder)
        if publish(spark, folder, version, expected):
            return version
    raise TimeoutError(f"{folder}: other writers were first {tries} times")


def current(spark: SparkSession, folder: str) -> str | None:
    """The path of the current version, None before the first."""
    fs, root = _fs(spark, folder)
    if not fs.exists(root):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("current-"))
    return spark.read.text(f"{folder}/{names[-1]}").first()[0] if names else None


def write_part(df: DataFrame, folder: str, part: int) -> None:
    """Writes a numbered part of a table; writing it again, as a stream does after a failure, puts it in place of the first time's."""
    df.write.mode("overwrite").parquet(f"{folder}/part={part}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old that new has no key of, and all of new. Of several new rows with one key any one is taken."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def rebuild(new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a table that is emptied and filled anew: the first of each key by all columns, rows without a whole key are ignored."""
    whole = new.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    rest = [c for c in new.columns if c not in keys]
    first = whole.groupBy(*keys).agg(F.min(F.struct(*rest) if rest else F.lit(0)).alias("__first"))
    return first.select(*[F.col(f"__first.{c}").alias(c) if c in rest else F.col(c) for c in new.columns])


def flat_name(path) -> object:
    """A page's path as one file name: slashes as double hyphens."""
    return F.replace(path, F.lit("/"), F.lit("--"))


def export_pages(pages: DataFrame, folder: str, partitions: int = 16) -> None:
    """Writes wiki_path and text as JSON lines with flattened names and links that follow them; a few large files, not one per page."""
    rewritten = pages.select(flat_name(F.col("wiki_path")).alias("name"), rewrite_links(F.col("text")).alias("text"))
    rewritten.repartition(partitions, "name").write.mode("overwrite").json(folder)


#: a relative link to a page below, with its anchor
_LINK = r"\]\((?![a-z][a-z0-9+.-]*:|\.\./|/)[^)\s]*\.md(?:#[^)\s]*)?\)"


def rewrite_links(text) -> object:
    """Relative links to pages below point at their flattened names, however deep; links to other places and above stay."""

    def flat(link):
        target = F.substring_index(link, "#", 1)
        own = F.regexp_extract(target, r"^\]\((?:\./)?", 0)
        return F.concat(own, flat_name(F.substr(target, F.length(own) + 1)), F.substr(link, F.length(target) + 1))

    links = F.transform(F.regexp_extract_all(text, F.lit(_LINK), 0), flat)
    # the text between the links is one part longer than the links
    return F.concat_ws("", F.flatten(F.zip_with(F.split(text, _LINK, -1), F.concat(links, F.array(F.lit(""))), lambda a, b: F.array(a, b))))


def search_records(pages: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """record: a JSON object per parsed page with its address, title, group and headings, for a viewer's own index; with texts (wiki_path,
    text) also the beginning of its prose."""
    heads = F.transform("headings", lambda h: h["text"])
    fields = [F.coalesce("title", "wiki_path").alias("title"), page_group(F.col("wiki_path")).alias("group"), F.col("wiki_path").alias("url"), heads.alias("headings")]
    if texts is not None:
        pages = pages.join(texts.groupBy("wiki_path").agg(F.max(plain_excerpt(F.col("text"))).alias("__excerpt")), "wiki_path", "left")
        fields.append(F.coalesce("__excerpt", F.lit("")).alias("text"))
    return pages.select(F.to_json(F.struct(*fields)).alias("record"))

"""Telling hand-written source from generated, minified, compiled and vendored files and bodies of data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.rules import judge
from codeloom.operators.graph import components
from codeloom.plans.lineage import cut

#: directories that hold what others wrote (fixed values, compared without case)
VENDOR_DIRS = ("vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "jspm_packages", "external", "externals", "site-packages", "pods", "godeps")
#: endings of prose and configuration, which are no source (fixed values)
PROSE = ("md", "markdown", "rst", "txt", "adoc", "toml", "yml", "yaml", "ini", "cfg", "conf", "properties", "editorconfig", "gitignore")
LEAST_LINE = 12


def source_extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def in_vendor_dir(path: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/"), F.array(*map(F.lit, VENDOR_DIRS))), F.lit(False))


def repository(path: Column) -> Column:
    """The first two segments of a path name the repository a file is in."""
    return F.substring_index(path, "/", 2)


def line_hashes(content: Column) -> Column:
    """The distinct hashes of a text's lines, without blanks at their ends, of at least 12 characters, as an array."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.trim(F.translate(x, "\r\t\ufeff", "   ")))
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= LEAST_LINE), lambda x: F.xxhash64(x)))


def reference_families(refs: DataFrame, rare: int, alike: float = 0.6) -> DataFrame:
    """ref, family: references that are variants of each other, found from the lines that more than `rare` references have.

    Two references are variants if the lines that they share are at least `alike` of each. A line's references are
    compared with the first and the last of them, not in all pairs, and variants of variants are one family. References without
    variants have no row. refs: ref, hs.
    """
    lines = refs.select("ref", F.explode("hs").alias("h"))
    hot = lines.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("ref").alias("a"), F.max("ref").alias("z")).where(F.col("df") > rare)
    met = lines.join(hot, "h").select("ref", F.explode(F.array("a", "z")).alias("to")).where(F.col("ref") != F.col("to")).distinct()
    met = met.join(refs.select("ref", "hs"), "ref").join(refs.select(F.col("ref").alias("to"), F.col("hs").alias("theirs")), "to")
    near = met.where(F.size(F.array_intersect("hs", "theirs")) >= alike * F.greatest(F.size("hs"), F.size("theirs")))
    return components(near.select(F.col("ref").alias("src"), F.col("to").alias("dst"))).select(F.col("node").alias("ref"), F.col("component").alias("family"))


def vendored_copies(contents: DataFrame, places: DataFrame, catalog: DataFrame, rare: int = 8, contained: float = 0.6, shared: int = 2, common: float = 0.9, least: int = 5) -> DataFrame:
    """file_id and containment of files that are copies, also edited ones, of third-party files.

    References are the files of the catalog and those that lie in vendor directories of any repository. A line is rare if at
    most `rare` families of references have it, a family being the variants of one file, so that a file that lies, edited or
    not, in a third of all repositories stays rare. A file is a copy if a reference of the catalog or of another repository has
    `contained` of its lines, and of these at least `shared` and a twentieth of its lines are rare. A file without so many rare lines, of at least
    `least` lines, is one only if a reference has `common` of its lines.

    A file can be a copy only if it shares one of its rarest lines with the reference, as many as may differ and one more:
    only these are looked up in the index of lines, and the exact share is computed for what they hit. The least common lines go
    first, and lines that no reference has count among them. So nothing that has the shares asked for is lost.

    contents: file_id, content. places: file_id, repo, vendor (whether it lies in a vendor directory). catalog: content and any
    other columns. Lines are taken as a set, equal sets are looked at once, however many files have them. Only line hashes are shuffled.
    The result is written to the shared folder, and nothing stays cached.
    """
    kept = F.array_sort(line_hashes(F.col("content")))
    sets = contents.select("file_id", kept.alias("hs")).where(F.size("hs") > 0).join(places.select("file_id", "repo", "vendor"), "file_id")
    sets = sets.withColumn("set", F.xxhash64("hs")).persist(StorageLevel.MEMORY_AND_DISK)
    # one file stands for each set; sets are dealt by file_id already, so that the arrays needn't move again
    first = sets.groupBy("set").agg(F.min("file_id").alias("file_id")).select("file_id")
    own = sets.join(first, "file_id", "left_semi").select("file_id", "set", "hs")
    known = catalog.where("content is not null").select(F.lit("").alias("home"), kept.alias("hs")).where(F.size("hs") > 0)
    taken = sets.where("vendor").select(F.col("repo").alias("home"), "hs")
    refs = known.unionByName(taken).groupBy(F.xxhash64("hs").alias("ref")).agg(F.min("home").alias("home"), F.max("home").alias("far"), F.first("hs").alias("hs"))
    # a reference of the catalog or of several repositories is foreign to every repository
    refs = refs.select("ref", F.when(F.col("home") == F.col("far"), F.col("home")).otherwise("").alias("origin"), "hs").persist(StorageLevel.MEMORY_AND_DISK)
    lines = refs.select("ref", F.explode("hs").alias("h"))
    held = refs.join(reference_families(refs, rare), "ref", "left").select(F.coalesce("family", "ref").alias("family"), F.explode("hs").alias("h"))
    held = held.groupBy("h", "family").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.sum("n").alias("df"), (F.count(F.lit(1)) <= rare).alias("tells"))
    hits = own.select("file_id", F.size("hs").alias("n"), F.explode("hs").alias("h")).join(held.hint("shuffle_hash"), "h")
    hits = hits.groupBy("file_id", "n").agg(F.count(F.lit(1)).alias("known"), F.sort_array(F.collect_list(F.struct(~F.col("tells"), "df", "h"))).alias("lines"))
    told = F.filter("lines", lambda x: ~x["col1"])
    telling = (F.size(told) >= F.least(F.lit(shared), F.col("n"))) & (F.size(told) >= 0.05 * F.col("n"))
    asked = F.when(telling, F.lit(contained)).when(F.col("n") >= least, F.lit(common))
    # how many of the known lines may be missed, and one more; the little that is taken off is for rounding
    hits = hits.withColumns({"told": told, "asked": asked}).withColumn("k", (F.col("known") - F.ceil(F.col("asked") * F.col("n") - 1e-9) + 1).cast("int")).where("k > 0")
    looked = F.when(F.col("asked") == F.lit(contained), F.col("told.h")).otherwise(F.col("lines.h"))
    hits = hits.select("file_id", "asked", F.col("told.h").alias("told"), F.slice(looked, F.lit(1), F.col("k")).alias("looked")).persist(StorageLevel.MEMORY_AND_DISK)
    probes = hits.select("file_id", F.explode("looked").alias("h"))
    candidates = probes.join(lines.join(probes.select("h").distinct(), "h", "left_semi"), "h").select("file_id", "ref").distinct()
    # exact containment of the candidates, over all lines
    pairs = candidates.join(refs.select("ref", "origin", F.col("hs").alias("theirs")), "ref").join(hits.select("file_id", "asked", "told"), "file_id").join(own, "file_id")
    evidence = F.size(F.array_intersect("told", "theirs"))
    enough = (evidence >= F.least(F.lit(shared), F.size("hs"))) & (evidence >= 0.05 * F.size("hs"))
    share = F.size(F.array_intersect("hs", "theirs")) / F.size("hs")
    met = pairs.select("set", "origin", share.alias("share"), F.when(enough, F.lit(contained)).when(F.size("hs") >= least, F.lit(common)).alias("need")).where("share >= need")
    # of each set the best reference, and the best one of another origin for files of the first one's repository
    met = met.groupBy("set", "origin").agg(F.max("share").alias("share")).persist(StorageLevel.MEMORY_AND_DISK)
    best = met.groupBy("set").agg(F.max(F.struct("share", "origin")).alias("b"))
    other = met.join(best, "set").where(F.col("origin") != F.col("b.origin")).groupBy("set").agg(F.max("share").alias("second"))
    best = best.join(other, "set", "left")
    found = sets.select("file_id", "set", "repo").join(best, "set")
    foreign = F.when(F.col("b.origin") != F.coalesce("repo", F.lit("?")), F.col("b.share")).otherwise(F.col("second"))
    out = cut(found.select("file_id", foreign.alias("containment")).where("containment is not null"))
    for cached in (sets, refs, hits, met):
        cached.unpersist()
    return out


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        kinds = [judge(p, e, t) for p, e, t in zip(b["path"], b["ext"], b["content"])]
        out = pd.DataFrame({"file_id": b["file_id"], "reason": kinds})
        yield out[out["reason"].notna()]


def unwritten_files(files: DataFrame, contents: DataFrame, catalog: DataFrame) -> DataFrame:
    """file_id, reason and containment of files that nobody wrote by hand here.

    reason is `vendored` (a possibly edited copy of a third-party file, with the share of its lines that one has as containment, or, where
    no content tells, a file in a vendor directory, with a null containment), `generated`, `compiled`, `minified` or `data`; a file has one,
    and vendored, the last by name, goes before the rest. Line sets tell copies, in any directory; a directory's name decides for what no set
    tells; the remaining files go by the composition of their text and by the marks that tools leave in their heads, see rules.py. Prose
    and configuration are no cases, and neither are files without content. A null path counts as an empty one.

    files: id, path; contents: file_id, content; catalog: content of third-party files. Other columns are not read.
    """
    path = F.coalesce("path", F.lit(""))
    places = files.select(F.col("id").alias("file_id"), path.alias("path"), source_extension(path).alias("ext"), repository(path).alias("repo"), in_vendor_dir(path).alias("vendor"))
    places = places.where(~F.col("ext").isin(*PROSE))
    texts = contents.select("file_id", "content").where("content is not null")
    none = F.lit(None).cast("double").alias("containment")
    placed = texts.select("file_id").join(places.where("vendor").select("file_id"), "file_id", "left_semi").select("file_id", F.lit("vendored").alias("reason"), none)
    copied = vendored_copies(texts, places, catalog).select("file_id", F.lit("vendored").alias("reason"), "containment")
    ruled = texts.join(places.where("not vendor").select("file_id", "path", "ext"), "file_id").mapInPandas(_judged, "file_id long, reason string").select("file_id", "reason", none)
    return placed.unionByName(copied).unionByName(ruled).groupBy("file_id").agg(F.max("reason").alias("reason"), F.max("containment").alias("containment"))

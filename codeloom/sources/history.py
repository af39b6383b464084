"""Tables that a version control log gives: changes per path, their times, and the files of a diff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_name_only_log(spark: SparkSession, path: str) -> DataFrame:
    """path, ts of each file in text logs of `log --name-only --format=@%ct`: lines of paths below a line with the commit's time.

    A file's lines are read whole, as a commit may span any cut; large histories come as many files.
    """
    whole = spark.read.text(path, wholetext=True)
    commits = whole.select(F.explode(F.split("value", r"(?m)^@")).alias("c")).where(F.length(F.trim("c")) > 0)
    lines = commits.select(F.split("c", r"\r?\n").alias("l"))
    return lines.select(F.trim(F.element_at("l", 1)).cast("long").alias("ts"), F.explode(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))).alias("path")).where("path <> ''").select("path", "ts")


def churn(log: DataFrame) -> DataFrame:
    return log.groupBy("path").agg(F.count(F.lit(1)).alias("commits"))


def path_times(log: DataFrame) -> DataFrame:
    return log.groupBy("path").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def changed_paths(diff: DataFrame) -> DataFrame:
    return diff.select("path").where("path is not null and path <> ''").distinct()


def read_ledger(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a JSON ledger; lines that can't be read come out with _corrupt_record, so a broken ledger isn't an empty one."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)

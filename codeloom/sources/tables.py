"""Reading the workspace tables: one parquet file or folder per table under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table of that name; only the columns a query uses are read from the files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")

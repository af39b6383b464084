"""Cutting long lineages in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, as spark.checkpoint.dir names it. Only a session on one machine, as in tests, may do without: it gets a
    temporary folder; on a cluster a missing setting is an error, as a machine's own folder would be lost with it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="codeloom-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder once and read from there from now on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

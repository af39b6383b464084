"""Micro-batch forms of the incremental operators, over folders of parquet files that new deliveries are added to."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_deliveries(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A stream of the rows of parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def weekly_stream(events: DataFrame, late: str = "7 days") -> DataFrame:
    """n and tokens per week of the event's time; rows that come later than `late` behind the newest are left out (an extension of the batch form)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime="4 days").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).select(F.to_date("w.start").alias("week"), "n", "tokens")


def deduplicated(events: DataFrame, key: str, late: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark, for deliveries that repeat rows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sync(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, interval: str = "1500 milliseconds"):
    """Runs apply(batch, batch_id) for each micro-batch, one at a time; with once it takes what is there and ends.

    apply must give the same result if a batch is repeated, as it is after a failure; what is pending stays in the checkpoint.
    """
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def with_retry(start: Callable[[], object], tries: int = 5, base: float = 1.0, most: float = 30.0, transient: Callable[[Exception], bool] = lambda e: False, sleep=time.sleep) -> int:
    """Starts a query and waits for it, again after failures with doubled pauses; transient failures don't count as tries. Returns the failures."""
    failures = counted = 0
    while True:
        try:
            start().awaitTermination()
            return failures
        except Exception as e:
            failures += 1
            counted += 0 if transient(e) else 1
            if counted >= tries:
                raise
            sleep(min(most, base * 2 ** (failures - 1)))


def append_ledger(batch: DataFrame, folder: str) -> None:
    """Adds rows to a ledger kept as parquet; existing files are never rewritten."""
    batch.write.mode("append").parquet(folder)

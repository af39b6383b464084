"""Micro-batches against the batch operators over the same rows."""

from codeloom.operators import activity
from codeloom.streaming import watch
from pyspark.sql import functions as F

SCHEMA = "seq long, page string, kind string, ts timestamp, tokens long"


def ledger(spark, n):
    return spark.range(n).select(F.col("id").alias("seq"), F.lit("p").alias("page"), F.lit("payment").alias("kind"), F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id") * 40_000).alias("ts"), F.col("id").alias("tokens"))


def test_weeks_equal_the_batch(spark, tmp_path):
    df = ledger(spark, 60)
    df.where("seq < 30").write.parquet(str(tmp_path / "in"))
    df.where("seq >= 30").write.mode("append").parquet(str(tmp_path / "in"))
    stream = watch.weekly_stream(watch.read_deliveries(spark, str(tmp_path / "in"), SCHEMA, 1), late="365 days")
    q = stream.writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("weeks").collect())) == sorted(map(tuple, activity.weekly(df, 99).collect()))


def test_sync_takes_each_delivery_once(spark, tmp_path):
    df = ledger(spark, 20)
    df.where("seq < 10").write.parquet(str(tmp_path / "in"))
    source = lambda: watch.read_deliveries(spark, str(tmp_path / "in"), SCHEMA)
    out = str(tmp_path / "out")
    for lo in (0, 10):
        if lo:
            df.where("seq >= 10").write.mode("append").parquet(str(tmp_path / "in"))
        watch.sync(source(), lambda b, _: watch.append_ledger(b, out), str(tmp_path / "cp"), once=True).awaitTermination()
        assert spark.read.parquet(out).count() == lo + 10


def test_repeats_are_dropped(spark, tmp_path):
    df = ledger(spark, 5)
    df.unionByName(df).write.parquet(str(tmp_path / "in"))
    stream = watch.deduplicated(watch.read_deliveries(spark, str(tmp_path / "in"), SCHEMA), "seq")
    q = stream.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 5


def test_retry():
    slept, left = [], [3]

    class Query:
        def awaitTermination(self):
            left[0] -= 1
            if left[0] >= 0:
                raise RuntimeError("busy")

    assert watch.with_retry(Query, tries=5, sleep=slept.append) == 3 and slept == [1, 2, 4]
    left[0] = 99
    try:
        watch.with_retry(Query, tries=2, sleep=slept.append)
        raise AssertionError
    except RuntimeError:
        pass
    left[0] = 7
    assert watch.with_retry(Query, tries=2, transient=lambda e: True, sleep=lambda s: slept.append(s)) == 7 and max(slept) <= 30

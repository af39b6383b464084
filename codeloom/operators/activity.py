"""Activity over an append-only ledger of events: totals, pairing by sequence, weeks, medians, token accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import round_half_up, week_start


def carried_last(df: DataFrame, order: str, value: Column, name: str, unit: int = 4096) -> DataFrame:
    """df with one more column: the last value that isn't null up to each row in order of the whole number `order`, over all rows.

    Blocks of `unit` numbers keep their last value, these are carried on from block to block, and each block looks through its own
    rows, so that the rows are not sorted in one task. A row without order has none.
    """
    blocked = df.withColumns({"__block": F.floor(F.col(order) / unit), "__value": value})
    lasts = blocked.where(F.col("__value").isNotNull() & F.col("__block").isNotNull()).groupBy("__block").agg(F.max(F.struct(F.col(order).alias("o"), F.col("__value").alias("v"))).alias("m"))
    every = blocked.select("__block").distinct().join(lasts, "__block", "left")
    before = every.select("__block", F.last("m.v", ignorenulls=True).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocked.join(before, "__block", "left").withColumn(name, F.coalesce(F.last("__value", ignorenulls=True).over(inside), "__before")).drop("__block", "__value", "__before")


def paired_payments(ledger: DataFrame, unit: int = 4096) -> DataFrame:
    """Payments with package_at, the time of the last package before them in ledger order, of whatever page, that had debts; only
    payments not older than it.

    ledger: seq, kind, ts, debt_count. Writes (`payment`) and resolved debts (`resolved`) both pay for a `package`. Order is that of
    seq, not of time. unit: how many numbers of seq make a block, see carried_last.
    """
    opened = F.when((F.col("kind") == "package") & (F.col("debt_count") > 0), F.col("ts"))
    paired = carried_last(ledger, "seq", opened, "package_at", unit)
    return paired.where("kind in ('payment', 'resolved') and package_at is not null and ts >= package_at")


def activity_totals(ledger: DataFrame) -> DataFrame:
    """One row: packages, payments, other events, tokens, and tokens per payment to one place (null without payments)."""
    paid = F.count_if(F.col("kind") == "payment")
    return ledger.agg(
        F.count_if(F.col("kind") == "package").alias("packages"),
        paid.alias("payments"),
        F.count_if(~F.col("kind").isin("package", "payment")).alias("others"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.when(paid > 0, round_half_up(F.sum("tokens") / paid)).alias("tokens_per_payment"),
    )


def weekly(ledger: DataFrame, weeks: int = 12) -> DataFrame:
    """week (a Monday in UTC), n, tokens of the last `weeks` weeks that have events."""
    out = ledger.groupBy(week_start(F.col("ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    return out.orderBy(F.desc("week")).limit(weeks)


def hours_to_pay(pairs: DataFrame) -> DataFrame:
    """One row: the exact median and the greatest time between package and payment, in hours to one place."""
    hours = (F.unix_micros("ts") - F.unix_micros("package_at")) / F.lit(3_600_000_000)
    return pairs.agg(round_half_up(F.median(hours)).alias("median_hours"), round_half_up(F.max(hours)).alias("max_hours"), F.count(F.lit(1)).alias("n"))


def running_total(df: DataFrame, order: str, value: str, unit: int = 4096) -> DataFrame:
    """df with running: the sum of `value` up to each row in order of the whole number `order`, without sorting all rows in one task.

    Rows are summed per block of `unit` numbers, the blocks' sums are added up, and each block adds its own rows.
    """
    blocked = df.withColumn("__block", F.floor(F.col(order) / unit))
    sums = blocked.groupBy("__block").agg(F.sum(value).alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    w = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocked.join(before, "__block").withColumn("running", F.col("before") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("__block", "before")


def top_pages(ledger: DataFrame, top: int = 10) -> DataFrame:
    """page, writes, tokens: most writes, then most tokens, then by name."""
    n = ledger.where("page is not null").groupBy("page").agg(F.count_if(F.col("kind") == "payment").alias("writes"), F.sum("tokens").alias("tokens"))
    return n.orderBy(F.desc("writes"), F.desc("tokens"), "page").limit(top)


def recent(ledger: DataFrame, last: int = 10) -> DataFrame:
    """The last rows of the ledger in its order."""
    return ledger.orderBy(F.desc("seq")).limit(last).orderBy("seq")


def first_last(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("n"))


def strict_sum(value: Column) -> Column:
    """The sum of a group that is null as soon as one value is."""
    return F.when(F.max(value.isNull()), None).otherwise(F.sum(value))


def token_account(usage: DataFrame, by: list[str]) -> DataFrame:
    """Tokens and cost by the given columns. usage: task, known, input_tokens, output_tokens, cost, and the columns.

    Within a task one attempt of known usage without a cost makes the task's cost null; across tasks null costs are left out.
    Attempts of unknown usage are skipped and make the result incomplete.
    """
    known = F.col("known")
    per_task = usage.groupBy(*by, "task").agg(
        F.sum(F.when(known, F.col("input_tokens"))).alias("input_tokens"),
        F.sum(F.when(known, F.col("output_tokens"))).alias("output_tokens"),
        F.when(F.max(known & F.col("cost").isNull()), None).otherwise(F.sum(F.when(known, F.col("cost")))).alias("cost"),
        F.max(~known).alias("incomplete"),
    )
    return per_task.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.max("incomplete").alias("incomplete"))


def breaker(attempts: DataFrame, by: str, order: str, consecutive: int = 3) -> DataFrame:
    """attempts with open: whether `consecutive` fails came in a row, or at least three were tried and over half failed, up to each row.

    attempts: failed (boolean), the group and the order within it; one group's rows are in one window.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fails, tried = F.sum(F.col("failed").cast("int")).over(w), F.count(F.lit(1)).over(w)
    last = Window.partitionBy(by).orderBy(order).rowsBetween(-(consecutive - 1), Window.currentRow)
    run = (F.sum(F.col("failed").cast("int")).over(last) == consecutive) & (tried >= consecutive)
    return attempts.withColumn("open", run | ((tried >= 3) & (fails / tried > 0.5)))

"""Regular time grids: bucketing, gap-free spines, filling and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "series_id"


def bucket(ts: str | Column, freq: str) -> Column:
    """The label of the bucket a time falls in: hour, day, month_end, or week (its last day, Sunday)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if freq == "week":
        return F.date_add(F.date_trunc("week", ts).cast("date"), 6).cast("timestamp_ntz")
    if freq == "month_end":
        return F.last_day(ts).cast("timestamp_ntz")
    if freq.endswith("min"):
        n = int(freq[:-3]) * 60
        return F.timestamp_seconds((F.unix_timestamp(ts.cast("timestamp")) / n).cast("long") * n).cast("timestamp_ntz")
    return F.date_trunc(freq, ts).cast("timestamp_ntz")


def resample(df: DataFrame, freq: str, how: str = "avg", by: str = KEY) -> DataFrame:
    """One row for each series and bucket that has rows; partial aggregates come before the shuffle."""
    return df.groupBy(by, bucket("ts", freq).alias("ts")).agg(F.expr(f"{how}(y)").alias("y"))


def _step(freq: str) -> str:
    if freq.endswith("min"):
        return f"INTERVAL {freq[:-3]} MINUTES"
    return {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS"}[freq]


def spine(df: DataFrame, freq: str, by: str = KEY) -> DataFrame:
    """Every step from each series' first to its last time."""
    ends = df.groupBy(by).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return ends.select(by, F.explode(F.expr(f"sequence(lo, hi, {_step(freq)})")).alias("ts"))


def on_grid(df: DataFrame, freq: str, by: str = KEY) -> DataFrame:
    """Rows of df on the spine; steps without a row have NULL (rows off the grid are lost, as with a reindex)."""
    return spine(df, freq, by).join(df, [by, "ts"], "left")


def _w(by: str = KEY):
    return W.partitionBy(by).orderBy("ts")


def forward_fill(df: DataFrame, col: str = "y", by: str = KEY) -> DataFrame:
    return df.withColumn(col, F.last(col, ignorenulls=True).over(_w(by).rowsBetween(W.unboundedPreceding, 0)))


def mean_fill(df: DataFrame, col: str = "y", by: str = KEY) -> DataFrame:
    return df.withColumn(col, F.coalesce(col, F.avg(col).over(W.partitionBy(by))))


def linear_fill(df: DataFrame, col: str = "y", by: str = KEY) -> DataFrame:
    """By row position between the neighbours that are known; after the last one its value, before the first NULL."""
    w = _w(by)
    past, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(col).isNotNull(), F.col("i_"))
    d = df.withColumn("i_", F.row_number().over(w))
    d = d.withColumns({"p_": F.last(col, ignorenulls=True).over(past), "ip_": F.last(at, ignorenulls=True).over(past), "n_": F.first(col, ignorenulls=True).over(ahead), "in_": F.first(at, ignorenulls=True).over(ahead)})
    between = F.col("p_") + (F.col("n_") - F.col("p_")) * (F.col("i_") - F.col("ip_")) / (F.col("in_") - F.col("ip_"))
    return d.withColumn(col, F.when(F.col(col).isNotNull(), F.col(col)).when(F.col("n_").isNull(), F.col("p_")).otherwise(between)).drop("i_", "p_", "ip_", "n_", "in_")


def date_range(spark, start: str, end: str, freq: str = "D") -> DataFrame:
    """Dates from start to end: D (days), B (Monday to Friday), ME (month ends)."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS d")
    if freq == "B":
        return days.where(F.weekday("d") < 5)
    return days.where(F.col("d") == F.last_day("d")) if freq == "ME" else days


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour, day, dayofweek (Monday 0), dayofyear, quarter, month and year of a time."""
    parts = {"hour": F.hour, "day": F.day, "dayofweek": F.weekday, "dayofyear": F.dayofyear, "quarter": F.quarter, "month": F.month, "year": F.year}
    return df.withColumns({n: f(ts).cast("long") for n, f in parts.items()})


def asof_join(left: DataFrame, right: DataFrame, value: str, by: str = KEY, within: str = "day") -> DataFrame:
    """Each left row with the latest right value at or before its time, without a range join.

    One union and one window for each series and ``within`` (hour, day, month), so that a long series
    is spread over tasks; what was last known before is carried over from the last values of the earlier
    ones, one row each.
    """
    both = left.withColumn("r_", F.lit(None).cast("double")).withColumn("k_", F.lit(1)).unionByName(
        right.select(by, "ts", F.col(value).alias("r_"), F.lit(0).alias("k_")), allowMissingColumns=True
    )
    both = both.withColumn("b_", F.date_trunc(within, "ts"))
    known = F.when(F.col("r_").isNotNull(), F.col("ts"))
    ends = both.groupBy(by, "b_").agg(F.max_by("r_", known).alias("end_"))
    carried = ends.withColumn("before_", F.last("end_", ignorenulls=True).over(W.partitionBy(by).orderBy("b_").rowsBetween(W.unboundedPreceding, -1))).drop("end_")
    w = W.partitionBy(by, "b_").orderBy("ts", "k_").rowsBetween(W.unboundedPreceding, 0)
    here = both.withColumn("here_", F.last("r_", ignorenulls=True).over(w)).where("k_ = 1")
    return here.join(carried, [by, "b_"]).withColumn(value, F.coalesce("here_", "before_")).drop("r_", "k_", "b_", "here_", "before_")

"""The driver's tables as panels (series_id, ts, y), in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import grid


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("y"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly means of events by type."""
    return grid.resample(raw_events(spark, d), "hour")


def hourly_full(spark: SparkSession, d: str) -> DataFrame:
    """The same on a gap-free grid, gaps filled forward."""
    return grid.forward_fill(grid.on_grid(hourly(spark, d), "hour"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Mean order price by day."""
    o = table(spark, d, "orders").select(F.lit("orders").alias("series_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y"))
    return grid.resample(o, "day")


def shipped(spark: SparkSession, d: str) -> DataFrame:
    """Mean line price by shipping day."""
    o = table(spark, d, "lineitem").select(F.lit("lines").alias("series_id"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("y"))
    return grid.resample(o, "day")


RAW = "raw AS (SELECT event_type AS series_id, ts, value AS y FROM events)"
HOURLY = RAW + ", hourly AS (SELECT series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(y) AS y FROM raw GROUP BY ALL)"
SPINE = HOURLY + (
    ", spine AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY series_id)"
    ", gaps AS (SELECT s.series_id, s.ts, h.y FROM spine s LEFT JOIN hourly h USING (series_id, ts))"
)
FULL = SPINE + ", p AS (SELECT series_id, ts, last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts) AS y FROM gaps)"
DAILY = "d AS (SELECT 'orders' AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) AS y FROM orders GROUP BY ALL)"
SHIPPED = "l AS (SELECT 'lines' AS series_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL)"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as engines add in other orders, and without negative zeros."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

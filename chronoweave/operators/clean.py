"""Typing and cleaning: parsing, coercion, missing values, codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.session import intermediate, materialise


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    """NaN as NULL in double columns, so that averages and counts skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def to_number(c: Column | str) -> Column:
    """Text as a double, NULL where it is none; thousands commas go."""
    return F.regexp_replace(c, ",", "").try_cast("double")


def to_whole(c: Column | str) -> Column:
    """Text with thousands commas as a nullable long."""
    return F.regexp_replace(c, ",", "").try_cast("long")


def to_time(c: Column | str, pattern: str | None = None) -> Column:
    """Text as a timestamp without time zone, NULL where it is none."""
    parsed = F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit(pattern)) if pattern else (F.col(c) if isinstance(c, str) else c).try_cast("timestamp_ntz")
    return parsed.cast("timestamp_ntz")


def suffixed_number(c: Column | str) -> Column:
    """Counts such as 1.2K or 3M as numbers."""
    c = F.col(c) if isinstance(c, str) else c
    scale = F.when(c.endswith("K"), 1e3).when(c.endswith("M"), 1e6).otherwise(1.0)
    return F.regexp_replace(c, "[KM]$", "").try_cast("double") * scale


def codes(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """Categories as whole numbers from 0 in sorted order; a null has none.

    The distinct values, not the rows, are ranked: dealt out by ranges and written as a table, each range
    numbers its own values from where the ranges before it end, one row a range.
    """
    with intermediate(df.sparkSession) as keep:
        values = df.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(col)
        values = materialise(values.withColumn("p_", F.spark_partition_id()), "values")
        sizes = values.groupBy("p_").agg(F.count("*").alias("n_"))
        before = F.coalesce(F.sum("n_").over(W.orderBy("p_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        at = F.row_number().over(W.partitionBy("p_").orderBy(col)) - 1
        ranked = values.join(sizes.withColumn("before_", before), "p_").select(col, (at + F.col("before_")).cast("long").alias(name))
        return keep(df.join(ranked, col, "left"))


def ordinal_date(c: Column | str) -> Column:
    """Days since 0001-01-01, which is day 1."""
    return (F.datediff(c, F.lit("0001-01-01").cast("date")) + 1).cast("long")


def canonical(df: DataFrame, ts: str, value: str, series: str | None = None) -> DataFrame:
    """The library's panel: series_id, ts (timestamp_ntz), y (double, NaN as NULL), rows without time or value dropped."""
    sid = F.col(series).cast("string") if series else F.lit("series")
    out = df.select(sid.alias("series_id"), F.col(ts).try_cast("timestamp_ntz").alias("ts"), F.col(value).try_cast("double").alias("y"))
    return nan_to_null(out, "y").dropna(subset=["ts", "y"])

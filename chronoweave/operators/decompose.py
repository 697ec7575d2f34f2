"""Decomposition, smoothing with fixed parameters and scaling, all built from window functions and folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.windows import centred_trend, numbered

KEY = "series_id"


def seasonal(df: DataFrame, period: int, kind: str = "additive") -> DataFrame:
    """trend (centred moving average), seasonal (mean of each slot, centred to 0 or 1) and resid; NULL trend at the edges."""
    times = kind == "multiplicative"
    d = numbered(centred_trend(df, period)).withColumn("slot", F.pmod("i", F.lit(period)))
    detrended = F.try_divide("y", "trend") if times else F.col("y") - F.col("trend")
    means = d.groupBy(KEY, "slot").agg(F.avg(detrended).alias("m"))
    centre = F.avg("m").over(W.partitionBy(KEY))
    means = means.select(KEY, "slot", (F.try_divide(F.col("m"), centre) if times else F.col("m") - centre).alias("seasonal"))
    out = d.join(means, [KEY, "slot"])
    resid = F.try_divide("y", F.col("trend") * F.col("seasonal")) if times else F.col("y") - F.col("trend") - F.col("seasonal")
    return out.withColumn("resid", resid).drop("slot", "i")


def component_summary(parts: DataFrame) -> DataFrame:
    """Of each series: trend direction and strength, seasonal amplitude, variance of the residuals."""
    known = F.col("trend").isNotNull()
    ends = parts.groupBy(KEY).agg(
        F.min_by("trend", F.when(known, F.col("ts"))).alias("first"), F.max_by("trend", F.when(known, F.col("ts"))).alias("last"), F.count("trend").alias("n"),
        (F.max("seasonal") - F.min("seasonal")).alias("amplitude"), F.var_samp("resid").alias("resid_var"),
    )
    return ends.select(KEY, F.when(F.col("last") > F.col("first"), "up").otherwise("down").alias("direction"), (F.abs(F.col("last") - F.col("first")) / F.col("n")).alias("strength"), "amplitude", "resid_var")


def _fold(df: DataFrame, start, step, name: str) -> DataFrame:
    """A recursion over each series' values in order; one series' values must fit a row."""
    held = df.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "y"))), lambda s: s["y"]).alias("ys"))
    return held.select(KEY, F.aggregate(F.slice("ys", 2, F.size("ys") - 1) if start == "first" else F.col("ys"), F.col("ys")[0] if start == "first" else start, step).alias(name))


def ses_level(df: DataFrame, alpha: float = 0.5) -> DataFrame:
    """The last level of simple exponential smoothing from the first value on: the flat forecast."""
    return _fold(df, "first", lambda s, y: F.lit(alpha) * y + F.lit(1 - alpha) * s, "level")


def holt_state(df: DataFrame, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """The last level and slope of Holt's method, from the first value and slope 0 on; forecast h is level + h * slope."""
    held = df.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "y"))), lambda s: s["y"]).alias("ys"))
    start = F.struct(F.col("ys")[0].alias("l"), F.lit(0.0).alias("b"))

    def step(s, y):
        level = alpha * y + (1 - alpha) * (s["l"] + s["b"])
        return F.struct(level.alias("l"), (beta * (level - s["l"]) + (1 - beta) * s["b"]).alias("b"))

    return held.select(KEY, F.aggregate(F.slice("ys", 2, F.size("ys") - 1), start, step).alias("s")).select(KEY, F.col("s.l").alias("level"), F.col("s.b").alias("slope"))


def croston(df: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Croston's forecast of intermittent demand: smoothed size over smoothed interval of the values above 0."""
    held = df.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "y"))), lambda s: s["y"]).alias("ys"))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("z"), none.alias("p"), F.lit(1.0).alias("q"))

    def step(s, y):
        hit = y > 0
        z = F.when(~hit, s["z"]).when(s["z"].isNull(), y).otherwise(alpha * y + (1 - alpha) * s["z"])
        p = F.when(~hit, s["p"]).when(s["p"].isNull(), s["q"]).otherwise(alpha * s["q"] + (1 - alpha) * s["p"])
        return F.struct(z.alias("z"), p.alias("p"), F.when(hit, F.lit(1.0)).otherwise(s["q"] + 1).alias("q"))

    return held.select(KEY, F.aggregate("ys", start, step).alias("s")).select(KEY, F.try_divide("s.z", "s.p").alias("forecast"))


def minmax(df: DataFrame, col: str = "y") -> DataFrame:
    """Scaled to [0, 1] by series; lo and hi are kept to turn it back."""
    ends = df.groupBy(KEY).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    return df.join(ends, KEY).withColumn("scaled", F.try_divide(F.col(col) - F.col("lo"), F.col("hi") - F.col("lo")))


def unminmax(df: DataFrame, col: str = "scaled", name: str = "y") -> DataFrame:
    return df.withColumn(name, F.col(col) * (F.col("hi") - F.col("lo")) + F.col("lo"))


def standard(df: DataFrame, col: str = "y") -> DataFrame:
    """Centred and divided by the population deviation; mu and sd are kept to turn it back."""
    ends = df.groupBy(KEY).agg(F.avg(col).alias("mu"), F.stddev_pop(col).alias("sd"))
    return df.join(ends, KEY).withColumn("scaled", F.try_divide(F.col(col) - F.col("mu"), F.col("sd")))


def unstandard(df: DataFrame, col: str = "scaled", name: str = "y") -> DataFrame:
    return df.withColumn(name, F.col(col) * F.col("sd") + F.col("mu"))

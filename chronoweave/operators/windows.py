"""Order-dependent features: every bundle shares one window, hence one exchange and one sort."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "series_id"


def ordered(by: str = KEY, ts: str = "ts") -> WindowSpec:
    return W.partitionBy(by).orderBy(ts)


def full(agg: Column, col: str, k: int, w: WindowSpec) -> Column:
    """An aggregate over the last k rows, NULL until the window is full."""
    return F.when(F.count(col).over(w) == k, agg.over(w))


def lags(df: DataFrame, *ks: int, col: str = "y") -> DataFrame:
    return df.withColumns({f"lag_{k}": F.lag(col, k).over(ordered()) for k in ks})


def rolling(df: DataFrame, *ks: int, col: str = "y") -> DataFrame:
    """Rolling mean and sample deviation, NULL until k values are there."""
    out = {}
    for k in ks:
        w = ordered().rowsBetween(1 - k, 0)
        out |= {f"mean_{k}": full(F.avg(col), col, k, w), f"std_{k}": full(F.stddev_samp(col), col, k, w)}
    return df.withColumns(out)


def rolling_band(df: DataFrame, k: int, width: float = 1.0, col: str = "y") -> DataFrame:
    """Rolling mean with lower and upper band of width deviations, and the exact quartiles of the window."""
    w = ordered().rowsBetween(1 - k, 0)
    mean, std = full(F.avg(col), col, k, w), full(F.stddev_samp(col), col, k, w)
    held = F.array_sort(F.collect_list(col).over(w))
    def quantile(p: float) -> Column:
        at = (k - 1) * p
        lo, part = int(at), at - int(at)
        a, b = F.get(held, F.lit(lo)), F.get(held, F.lit(min(lo + 1, k - 1)))
        return F.when(F.count(col).over(w) == k, a + (b - a) * part)
    return df.withColumns({"mean": mean, "lower": mean - width * std, "upper": mean + width * std, "q25": quantile(0.25), "q75": quantile(0.75)})


def rolling_apply(df: DataFrame, k: int, name: str, f: Callable[[Column], Column], col: str = "y") -> DataFrame:
    """Any aggregate of the last k values: f gets them as an array, in order, and returns an expression; NULL until k values are there."""
    held = F.collect_list(col).over(ordered().rowsBetween(1 - k, 0))
    return df.withColumn("held_", held).withColumn(name, F.when(F.size("held_") == k, f(F.col("held_")))).drop("held_")


def rolling_apply_numpy(df: DataFrame, k: int, name: str, f: Callable[[np.ndarray], np.ndarray], col: str = "y") -> DataFrame:
    """As rolling_apply() for what expressions can't say: f gets full windows as rows of a matrix and returns a number for each."""

    @F.pandas_udf("double")
    def apply(held: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=held.index)
        whole = held.map(len) == k
        if whole.any():
            out[whole] = f(np.stack(held[whole].to_list()))
        return out.astype(object).where(whole, None)

    held = F.collect_list(col).over(ordered().rowsBetween(1 - k, 0))
    return df.withColumn("held_", held).withColumn(name, apply("held_")).drop("held_")


def convolved(df: DataFrame, kernel: list[float], name: str = "convolved", col: str = "y") -> DataFrame:
    """Discrete convolution where the kernel lies wholly on the series ("valid"): kernel[0] meets the latest value; other rows are left out."""
    parts = [F.lag(col, i).over(ordered()) * w for i, w in enumerate(kernel)]
    return df.withColumn(name, reduce(lambda a, b: a + b, parts)).where(F.col(name).isNotNull())


def expanding(df: DataFrame, col: str = "y") -> DataFrame:
    """Mean and sample deviation of all rows so far; the first deviation is 0."""
    w = ordered().rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({"mean": F.avg(col).over(w), "std": F.coalesce(F.stddev_samp(col).over(w), F.lit(0.0)), "n": F.count(col).over(w)})


def changes(df: DataFrame, col: str = "y") -> DataFrame:
    """First difference, relative change and log return."""
    before = F.lag(col).over(ordered())
    return df.withColumns({"diff": F.col(col) - before, "pct": F.try_divide(F.col(col) - before, before), "logret": F.when((F.col(col) > 0) & (before > 0), F.log(F.col(col) / before))})


def cumulated(df: DataFrame, col: str, name: str = "total") -> DataFrame:
    return df.withColumn(name, F.sum(col).over(ordered().rowsBetween(W.unboundedPreceding, 0)))


def compounded(df: DataFrame, col: str, name: str = "product") -> DataFrame:
    """Running product of positive factors, as the exponential of a sum of logarithms."""
    return df.withColumn(name, F.exp(F.sum(F.log(col)).over(ordered().rowsBetween(W.unboundedPreceding, 0))))


def gradient(df: DataFrame, col: str = "y") -> DataFrame:
    """Half the distance between the neighbours; at the ends the one-sided difference."""
    ahead, before = F.lead(col).over(ordered()), F.lag(col).over(ordered())
    return df.withColumn("grad", F.when(before.isNull(), ahead - F.col(col)).when(ahead.isNull(), F.col(col) - before).otherwise((ahead - before) / 2))


def fourier(df: DataFrame, *periods: int, order: int = 1) -> DataFrame:
    """sin and cos of 2 pi k t / period, t being the row's number from 0."""
    t = F.row_number().over(ordered()) - 1
    out = {}
    for p in periods:
        for k in range(1, order + 1):
            angle = t * (2 * pi * k / p)
            out |= {f"sin_{p}_{k}": F.sin(angle), f"cos_{p}_{k}": F.cos(angle)}
    return df.withColumns(out)


def supervised(df: DataFrame, lag: int, col: str = "y") -> DataFrame:
    """The lag values before each row as an array x; rows without that many are left out."""
    held = F.collect_list(col).over(ordered().rowsBetween(-lag, -1))
    return df.withColumn("x", held).where(F.size("x") == lag)


def delay_embedding(df: DataFrame, dims: int, delay: int, col: str = "y") -> DataFrame:
    """Row i as (s[i], s[i + delay], ...); rows that lack the last one are left out."""
    parts = {f"e{d}": F.lead(col, d * delay).over(ordered()) for d in range(dims)}
    return df.withColumns(parts).where(F.col(f"e{dims - 1}").isNotNull())


def centred_trend(df: DataFrame, period: int, col: str = "y") -> DataFrame:
    """Centred moving average; of an even period half weights at both ends; NULL where the window isn't full."""
    half = period // 2
    w = ordered().rowsBetween(-half, half)
    n = 2 * half + 1
    if period % 2:
        return df.withColumn("trend", full(F.avg(col), col, n, w))
    ends = (F.lag(col, half).over(ordered()) + F.lead(col, half).over(ordered())) / 2
    return df.withColumn("trend", F.when(F.count(col).over(w) == n, (F.sum(col).over(w) - ends) / period))


def numbered(df: DataFrame, name: str = "i") -> DataFrame:
    """The row's number from 0 within its series."""
    return df.withColumn(name, (F.row_number().over(ordered()) - 1).cast("long"))

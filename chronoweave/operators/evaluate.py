"""Splits, cross-validation folds and error measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "series_id"


def tail(df: DataFrame, n: int, by: str = KEY) -> DataFrame:
    """The last n rows of each series."""
    return df.withColumn("r_", F.row_number().over(W.partitionBy(by).orderBy(F.col("ts").desc()))).where(F.col("r_") <= n).drop("r_")


def holdout(df: DataFrame, n: int, by: str = KEY) -> DataFrame:
    """Adds part: test for the last n rows of each series, else train."""
    r = F.row_number().over(W.partitionBy(by).orderBy(F.col("ts").desc()))
    return df.withColumn("part", F.when(r <= n, "test").otherwise("train"))


def fraction(df: DataFrame, share: float, by: str = KEY) -> DataFrame:
    """Adds part by order: the first floor(n * share) rows are train."""
    w = W.partitionBy(by)
    r = F.row_number().over(w.orderBy("ts"))
    return df.withColumn("n_", F.count("*").over(w)).withColumn("part", F.when(r <= F.floor(F.col("n_") * share), "train").otherwise("test")).drop("n_")


def split_at(df: DataFrame, time: str) -> DataFrame:
    """Adds part: train for rows before a time, else test."""
    return df.withColumn("part", F.when(F.col("ts") < F.lit(time).cast("timestamp_ntz"), "train").otherwise("test"))


def hashed_split(df: DataFrame, key: str, percent: int) -> DataFrame:
    """Adds part by a hash of the key: about percent of the rows are train, the same ones at every run."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn("part", F.when(number % 100 < percent, "train").otherwise("test"))


def naive_backtest(df: DataFrame, season: int, windows: int, by: str = KEY) -> DataFrame:
    """Seasonal-naive forecasts of the last ``windows`` seasons, one cutoff each: (series, cutoff, h, y, yhat) from one window and one join."""
    r = F.row_number().over(W.partitionBy(by).orderBy(F.col("ts").desc())) - 1
    d = df.withColumn("r_", r).where(F.col("r_") < season * (windows + 1)).withColumns({"k_": F.floor(F.col("r_") / season), "h": season - F.col("r_") % season})
    test = d.where(F.col("k_") < windows).select(by, F.col("k_").alias("cutoff"), "h", "y")
    return test.join(d.where("k_ > 0").select(by, (F.col("k_") - 1).alias("cutoff"), "h", F.col("y").alias("yhat")), [by, "cutoff", "h"])


def folds(n: int, scheme: str, k: int = 5, window: int = 0, step: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(fold, train_from, train_to, test_from, test_to), ends excluded, of n rows in order.

    ts_split: k tests of n // (k + 1) rows at the end, trained on all before.
    expanding: sizes of n // (k + 1), train grows. rolling and sliding: train of
    window rows, test of step rows, moved on by step, as often as both are whole. blocked: each of k blocks is
    tested and the others train (train_from, train_to are then the whole range).
    """
    if scheme == "ts_split":
        size = n // (k + 1)
        return [(i, 0, n - (k - i) * size, n - (k - i) * size, n - (k - i - 1) * size) for i in range(k)]
    if scheme == "expanding":
        size = n // (k + 1)
        return [(i, 0, (i + 1) * size, (i + 1) * size, (i + 2) * size) for i in range(k)]
    if scheme in ("rolling", "sliding"):
        return [(i, i * step, i * step + window, i * step + window, (i + 1) * step + window) for i in range((n - window) // step)]
    if scheme == "blocked":
        size = n // k
        return [(i, 0, k * size, i * size, (i + 1) * size) for i in range(k)]
    raise ValueError(scheme)


def with_folds(df: DataFrame, scheme: str, k: int = 5, window: int = 0, step: int = 0, index: str = "i", by: str = KEY) -> DataFrame:
    """Each row once for each fold of folds() that it is in, with fold and part; in blocked folds tests aren't in train.

    The folds of a row follow from its index and its series' length alone, so no fold
    table meets the rows. Series whose length gives no fold are left out.
    """
    i, n = F.col(index), F.col("n_")
    f = F.col("fold")
    if scheme in ("rolling", "sliding"):
        first = F.greatest(F.lit(0).cast("long"), F.ceil((i - window - step + 1) / step))
        last = F.least(F.floor(i / step), F.floor((n - window - step) / step))
        begin, test_from, test_to = f * step, f * step + window, f * step + window + step
    else:
        first, last = F.lit(0).cast("long"), F.lit(k - 1).cast("long")
        size = F.floor(n / (k if scheme == "blocked" else k + 1))
        if scheme == "ts_split":
            test_from = n - (k - f) * size
        elif scheme == "expanding":
            test_from = (f + 1) * size
        elif scheme == "blocked":
            test_from = f * size
        else:
            raise ValueError(scheme)
        begin, test_to = F.lit(0), test_from + size
    train_to = k * size if scheme == "blocked" else test_from
    sizes = df.groupBy(F.col(by).alias("s_")).agg(F.count("*").alias("n_"))
    each = df.join(sizes, F.col(by).eqNullSafe(F.col("s_"))).where(first <= last).withColumn("fold", F.explode(F.sequence(first, last)))
    test = (i >= test_from) & (i < test_to)
    part = F.when(test, "test").when((i >= begin) & (i < train_to), "train")
    return each.withColumn("part", part).where("part IS NOT NULL").drop("s_", "n_")


def metrics(actual: Column | str = "y", predicted: Column | str = "yhat") -> dict[str, Column]:
    """Aggregates: mse, rmse, mae, mape (a fraction, rows with actual 0 left out), smape, r2 and n."""
    a, f = (F.col(c) if isinstance(c, str) else c for c in (actual, predicted))
    e = a - f
    sse = F.sum(e * e)
    return {
        "n": F.count(e), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)),
        "mape": F.avg(F.abs(F.try_divide(e, a))), "smape": F.avg(F.try_divide(2 * F.abs(e), F.abs(a) + F.abs(f))),
        "r2": 1 - F.try_divide(sse, F.var_pop(F.when(e.isNotNull(), a)) * F.count(e)),
    }


def score(df: DataFrame, by: list[str], actual: str = "y", predicted: str = "yhat") -> DataFrame:
    return df.groupBy(*by).agg(*(c.alias(n) for n, c in metrics(actual, predicted).items()))


def accuracy(df: DataFrame, by: list[str], actual: str = "y", predicted: str = "yhat") -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))

"""Kernel-weighted trends and the choice of a smoothing form, dealt out as rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.aggregates import percentiles
from chronoweave.operators.models import minimise, smooth
from chronoweave.operators.regress import fitted, products, solved
from chronoweave.operators.sampled import shock

KEY = "series_id"


def kernel_weights(at: Column, knots: int, width: float) -> list[Column]:
    """Normal kernels around evenly spaced knots on [0, 1], scaled to a sum of 1."""
    raw = [F.exp(-F.pow((at - j / (knots - 1)) / width, F.lit(2)) / 2) for j in range(knots)]
    total = reduce(lambda a, b: a + b, raw)
    return [r / total for r in raw]


def kernel_trend(df: DataFrame, knots: int = 6, width: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """The rows with their trend, and (series_id, n, level, sigma) with a level for each knot: a regression on kernel weights of each row's place in time.

    Normal equations are one aggregate of sums of products; levels are solved a series at a time from knots squared numbers.
    sigma is the deviation of what is left. Rows without a value get a trend and don't count in it. A series with
    no more values than knots has NULLs.
    """
    w = W.partitionBy(KEY)
    placed = df.withColumn("at_", F.coalesce(F.try_divide(F.row_number().over(w.orderBy("ts")) - 1, F.count("*").over(w) - 1), F.lit(0.0)))
    weights = kernel_weights(F.col("at_"), knots, width)

    def solve(n: int, g: np.ndarray) -> tuple:
        if n <= knots:
            return None, None
        b, rest = fitted(g, list(range(knots)), knots)
        return b.tolist(), float(np.sqrt(rest / (n - knots)))

    sums = products(placed, KEY, [*weights, F.col("y")], F.col("y").isNotNull())
    levels = sums.select(KEY, "n").join(solved(sums, KEY, solve, "level array<double>, sigma double"), KEY)
    both = placed.join(levels.select(KEY, "level"), KEY)
    trend = reduce(lambda a, b: a + b, (x * F.col("level")[j] for j, x in enumerate(weights)))
    return both.withColumn("trend", trend).drop("at_", "level"), levels


def kernel_forecast(levels: DataFrame, h: int, draws: int = 200, low: float = 0.05, high: float = 0.95, seed: int = 0) -> DataFrame:
    """(series_id, h, yhat, lo, hi): the last knot's level carried on; bands are percentiles of draws whose level walks by the knots' own changes and whose values get residual noise.

    A knot's step counts as n / (knots - 1) rows, so that a draw's level has wandered by the root of h of these; draws are rows, their shocks are hashes.
    """
    known = levels.where("level is not null")
    steps = F.zip_with(F.slice("level", 2, F.size("level") - 1), F.slice("level", 1, F.size("level") - 1), lambda b, a: (b - a) * (b - a))
    wander = F.sqrt(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) / F.size(steps) / (F.col("n") / F.size(steps)))
    d = known.withColumns({"last": F.element_at("level", -1), "wander": wander, "draw": F.explode(F.sequence(F.lit(1), F.lit(draws)))}).repartition(KEY, "draw")
    d = d.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
    part = lambda name, *more: shock(F.col(KEY), F.col("draw").cast("string"), F.lit(name), *more, F.lit(str(seed)))
    y = F.col("last") + F.col("wander") * F.sqrt("h") * part("level") + F.col("sigma") * part("noise", F.col("h").cast("string"))
    rows = d.select(F.struct(KEY, "h", F.col("last").alias("yhat")).alias("g"), y.alias("y"))
    return percentiles(rows, {"lo": low, "hi": high}, "g").select("g.*", "lo", "hi")


#: Forms of smoothing: trend (none, linear, damped) and season (none, additive).
FORMS = [(t, s) for t in ("none", "linear", "damped") for s in (False, True)]


def _form_fit(y: np.ndarray, trend: str, season: int, h: int) -> tuple[float, np.ndarray]:
    """Corrected AIC and forecasts of one form."""
    n, free = len(y), 2 + (trend != "none") * 2 + (trend == "damped") + (season > 1) * season
    if n <= max(free + 2, 2 * season + 1):
        raise ValueError("too short")
    start = max(season, 1)

    def unpack(w):
        a, b, g, damp = 1 / (1 + np.exp(-w))
        return a, b if trend != "none" else 0.0, g if season > 1 else 0.0, damp if trend == "damped" else 1.0 if trend == "linear" else 0.0

    def run(w):
        a, b, g, damp = unpack(w)
        return smooth(y, a, b, g, season, damp)

    w = minimise(lambda w: float((run(w)[0][start:] ** 2).sum()), np.array([-1.0, -3.0, -2.0, 3.0]), 80, 1.0)
    e, level, slope, s = run(w)
    rest = e[start:]
    k, m = free + 1, len(rest)
    aicc = m * np.log(max(rest @ rest / m, 1e-300)) + 2 * k + 2 * k * (k + 1) / max(m - k - 1, 1)
    damp = unpack(w)[3]
    ahead = level + slope * np.cumsum(damp ** np.arange(1, h + 1)) + s[(n + np.arange(h)) % season]
    return float(aicc), ahead


def smoothing_choice(panel: DataFrame, h: int, season: int = 24) -> DataFrame:
    """(series_id, trend, seasonal, aicc, h, yhat): for each series the form of smoothing with the least corrected AIC.

    Series and forms are dealt out together, six rows a series; forms that a series is too short for are left out, and a
    series too short for all of them gives no rows.
    """
    kind = dict(panel.dtypes)[KEY]

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        trend, seasonal = FORMS[key[1]]
        try:
            aicc, ahead = _form_fit(pdf.sort_values("ts")["y"].to_numpy(float), trend, season if seasonal else 1, h)
        except ValueError:
            return pd.DataFrame(columns=[KEY, "form", "aicc", "path"])
        return pd.DataFrame({KEY: [key[0]], "form": [key[1]], "aicc": [aicc], "path": [ahead.tolist()]})

    dealt = panel.where("y is not null").select(KEY, "ts", "y", F.explode(F.sequence(F.lit(0), F.lit(len(FORMS) - 1))).alias("form"))
    fits = dealt.groupBy(KEY, "form").applyInPandas(fit, f"{KEY} {kind}, form int, aicc double, path array<double>")
    best = fits.groupBy(KEY).agg(F.min_by(F.struct("form", "aicc", "path"), F.struct(F.round("aicc", 9), "form")).alias("b")).select(KEY, "b.*")
    named = F.array(*(F.struct(F.lit(t).alias("trend"), F.lit(s).alias("seasonal")) for t, s in FORMS))
    at = best.withColumn("f", F.get(named, F.col("form"))).select(KEY, "f.*", "aicc", F.posexplode("path").alias("h", "yhat"))
    return at.select(KEY, "trend", "seasonal", "aicc", (F.col("h") + 1).cast("long").alias("h"), "yhat")

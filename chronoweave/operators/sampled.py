"""Sampled forecasts: every draw is a row, and its shocks are hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.aggregates import percentiles

KEY = "series_id"


def autoregression(df: DataFrame, lags: int = 2) -> DataFrame:
    """(series_id, n, coefficients, sigma, last): least squares of y on a constant and its lags; last holds the last values, the latest at the end.

    The sums of products are one aggregate, whose few numbers a series are solved where they are. Rows without a
    value are left out before lags are taken; a series too short for its lags has none of the three.
    """
    w = W.partitionBy(KEY).orderBy("ts")
    known = df.where("y is not null").withColumns({f"x{k}": F.lag("y", k).over(w) for k in range(1, lags + 1)})
    mean = known.groupBy(KEY).agg(F.avg("y").alias("m_"))
    full = known.join(mean, KEY)
    terms = [F.lit(1.0), *(F.col(f"x{k}") - F.col("m_") for k in range(1, lags + 1)), F.col("y") - F.col("m_")]
    whole = F.col(f"x{lags}").isNotNull()
    sums = F.array(*(F.sum(F.when(whole, a * b)) for i, a in enumerate(terms) for b in terms[i:])).alias("sums")
    held = F.array(*(F.when(F.col(f"x{lags}").isNotNull(), F.col("y" if k == 0 else f"x{k}")) for k in reversed(range(lags))))
    found = full.groupBy(KEY).agg(F.count(F.when(whole, 1)).alias("n"), F.first("m_").alias("m"), sums, F.max_by(held, "ts").alias("last"))

    def solve(batches):
        at = np.triu_indices(lags + 2)
        for pdf in batches:
            rows = []
            for n, m, s, last in zip(pdf["n"], pdf["m"], pdf["sums"], pdf["last"]):
                if n <= lags + 1:
                    rows.append((None, None, None))
                    continue
                g = np.zeros((lags + 2, lags + 2))
                g[at] = s
                g += np.triu(g, 1).T
                b = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
                rest = max(g[-1, -1] - b @ g[:-1, -1], 0.0)
                b[0] += m * (1 - b[1:].sum())
                rows.append((b.tolist(), float(np.sqrt(rest / (n - lags - 1))), list(last)))
            out = pd.DataFrame(rows, columns=["coefficients", "sigma", "last"])
            out.insert(0, "n", pdf["n"].to_numpy())
            out.insert(0, KEY, pdf[KEY].to_numpy())
            yield out

    kind = dict(df.dtypes)[KEY]
    return found.mapInPandas(solve, f"{KEY} {kind}, n long, coefficients array<double>, sigma double, last array<double>")


def shock(*parts: Column) -> Column:
    """A normal number that depends on its parts alone: two numbers from their MD5, by Box and Muller."""
    digest = F.md5(F.concat_ws(":", *parts))
    unit = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / (1 << 32)
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * np.pi * unit(9))


def sampled_paths(fits: DataFrame, h: int, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(series_id, draw, step, y): paths of h steps from autoregression()'s coefficients with normal shocks.

    Draws are rows that are dealt out over tasks; a path is one fold over its steps, in built-ins. Shocks hash series, draw,
    step and seed, so that paths don't depend on how rows are dealt out. Series without coefficients give no rows.
    """
    lags = F.size("coefficients") - 1
    dealt = fits.where("coefficients is not null").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long")))).repartition(KEY, "draw")

    def ahead(past: Column, step: Column) -> Column:
        recent = F.reverse(F.slice(past, -lags, lags))
        mean = F.aggregate(F.zip_with(F.slice("coefficients", 2, lags), recent, lambda b, y: b * y), F.element_at("coefficients", 1), lambda s, v: s + v)
        noise = F.col("sigma") * shock(F.col(KEY), F.col("draw").cast("string"), step.cast("string"), F.lit(str(seed)))
        return F.concat(past, F.array(mean + noise))

    path = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(h)), F.col("last"), ahead), lags + 1, F.lit(h))
    at = dealt.withColumn("path", path).select(KEY, "draw", F.posexplode("path").alias("step", "y"))
    return at.select(KEY, "draw", (F.col("step") + 1).cast("long").alias("step"), "y")


def bands(paths: DataFrame, qs: dict[str, float]) -> DataFrame:
    """(series_id, step, mean, and an exact percentile for each of qs) of sampled_paths()."""
    grouped = paths.withColumn("g", F.struct(KEY, "step"))
    found = percentiles(grouped, qs, "g").select(F.col("g.*"), *qs)
    return paths.groupBy(KEY, "step").agg(F.avg("y").alias("mean")).join(found, [KEY, "step"]).select(KEY, "step", "mean", *qs)


def terminal_bands(ends: DataFrame, width: float = 0.67, col: str = "y") -> DataFrame:
    """Of each series' final values: number, mean, deviation, mean -/+ width deviations and the share of values between them."""
    line = ends.groupBy(KEY).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("sd"))
    line = line.withColumns({"lower": F.col("mean") - width * F.col("sd"), "upper": F.col("mean") + width * F.col("sd")})
    inside = F.avg(F.col(col).between(F.col("lower"), F.col("upper")).cast("double"))
    return ends.select(KEY, col).join(line, KEY).groupBy(*line.columns).agg(inside.alias("inside"))

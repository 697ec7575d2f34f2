"""Vector autoregressions of many groups of series, from sums of products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.regress import fitted, products, solved
from chronoweave.session import intermediate, materialise

KEY = "series_id"


def pairs(panel: DataFrame) -> DataFrame:
    """(series_id "a~b", ts, a, b): every two series of a panel at the times that both have; a pair of series a row of the panel, not of its rows."""
    p = panel.where("y is not null").select(KEY, "ts", "y")
    other = p.select(F.col(KEY).alias("o_"), "ts", F.col("y").alias("b"))
    return p.join(other, "ts").where(F.col(KEY) < F.col("o_")).select(F.concat_ws("~", KEY, "o_").alias(KEY), "ts", F.col("y").alias("a"), "b")


def _lagged(df: DataFrame, cols: list[str], top: int) -> DataFrame:
    """Centred columns c_0 and their lags c_1 to c_top, the row's number t and the number of rows n of its group."""
    w = W.partitionBy(KEY)
    line = df.groupBy(F.col(KEY).alias("g_")).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"{c}_m") for c in cols))
    rows = df.join(line, F.col(KEY).eqNullSafe(F.col("g_"))).withColumns({f"{c}_0": F.col(c) - F.col(f"{c}_m") for c in cols})
    by_time = w.orderBy("ts")
    return rows.withColumns({f"{c}_{k}": F.lag(f"{c}_0", k).over(by_time) for c in cols for k in range(1, top + 1)} | {"t": F.row_number().over(by_time) - 1}).drop("g_")


def _terms(cols: list[str], lags: int, now: bool = True) -> list[Column]:
    """A constant, all columns' lags, lag by lag, then the columns themselves."""
    return [F.lit(1.0), *(F.col(f"{c}_{k}") for k in range(1, lags + 1) for c in cols), *([F.col(f"{c}_0") for c in cols] if now else [])]


def _latest(cols: list[str], lags: int) -> Column:
    """The last values of the centred columns as lists, the latest first, and their means."""
    return F.max_by(F.struct(F.array(*(F.array(*(F.col(f"{c}_{k}") for c in cols)) for k in range(lags))).alias("past"), F.array(*(F.col(f"{c}_m") for c in cols)).alias("mean")), "t").alias("end")


def var_fit(df: DataFrame, cols: list[str], most: int = 15, order: int | None = None) -> DataFrame:
    """(series_id, n, order, coefficients, covariance, past, mean) of a vector autoregression of each group of rows (series_id, ts, cols).

    All orders up to ``most`` (n / 3 / columns at most) share one aggregate of sums of products over the rows that have all their lags; the order has
    the least AIC there unless it is given. coefficients has a row for the constant, then for each lag and column; values are less
    their ``mean``; past holds the last values, the latest first. Groups too short have NULLs.
    """
    k = len(cols)
    whole = df.where(" and ".join(f"{c} is not null" for c in cols))
    top = order or most
    rows = _lagged(whole, cols, top)
    bound = F.lit(order) if order else F.least(F.lit(most), F.floor(F.col("n") / (3 * k))).cast("int")
    rows = rows.withColumn("top", bound)
    sums = products(rows, KEY, _terms(cols, top), F.col("t") >= F.col("top"), F.first("top").alias("top"), _latest(cols, top))
    sums = sums.withColumns({"past": F.col("end.past"), "mean": F.col("end.mean")})

    def choose(n: int, g: np.ndarray, longest: int, past: np.ndarray, mean: np.ndarray) -> tuple:
        y, best = list(range(len(g) - k, len(g))), None
        for p in [order] if order else range(1, longest + 1):
            x = list(range(1 + p * k))
            if n <= len(x):
                break
            b = np.linalg.lstsq(g[np.ix_(x, x)], g[np.ix_(x, y)], rcond=None)[0]
            rest = (g[np.ix_(y, y)] - b.T @ g[np.ix_(x, y)]) / n
            aic = np.linalg.slogdet(rest)[1] + 2 * p * k * k / n
            if best is None or aic < best[0]:
                best = (aic, p, b, rest)
        if best is None:
            return None, None, None, None, None
        return best[1], best[2].tolist(), best[3].tolist(), [list(map(float, v)) for v in past[: best[1]]], list(map(float, mean))

    matrix = "array<array<double>>"
    fits = solved(sums, KEY, choose, f"order long, coefficients {matrix}, covariance {matrix}, past {matrix}, mean array<double>", "top", "past", "mean")
    return sums.select(KEY, "n").join(fits, KEY)


def var_path(past: list, coefficients: list, mean: list, h: int, shock: list | None = None, after: list | None = None) -> np.ndarray:
    """h steps ahead; ``after`` weighs the last shock in the first step."""
    b, m = np.asarray(coefficients, float), np.asarray(mean, float)
    k, held = len(m), [np.asarray(v, float) for v in past]
    out = []
    for i in range(h):
        y = b[0] + sum(held[j] @ b[1 + j * k : 1 + (j + 1) * k] for j in range((len(b) - 1) // k))
        if i == 0 and shock is not None:
            y = y + np.asarray(shock) @ np.asarray(after)
        held.insert(0, y)
        out.append(y + m)
    return np.array(out)


def var_forecast(df: DataFrame, cols: list[str], h: int, most: int = 15) -> DataFrame:
    """(series_id, h, order, a column's forecast for each of cols)."""
    fits = var_fit(df, cols, most).where("order is not null")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for s, p, b, past, mean in zip(pdf[KEY], pdf["order"], pdf["coefficients"], pdf["past"], pdf["mean"]):
                path = var_path(list(map(list, past)), np.stack(b), mean, h)
                yield pd.DataFrame({KEY: s, "h": np.arange(1, h + 1), "order": p} | {c: path[:, i] for i, c in enumerate(cols)})

    return fits.mapInPandas(run, f"{KEY} {dict(df.dtypes)[KEY]}, h long, order long, " + ", ".join(f"{c} double" for c in cols))


def varma_forecast(df: DataFrame, cols: list[str], h: int, p: int = 1, long: int | None = None) -> DataFrame:
    """(series_id, h, a column's forecast for each of cols) of a VARMA(p, 1): shocks are what a long autoregression leaves, then one regression on lags and the last shock; shocks to come are 0."""
    k, long = len(cols), long or p + 4
    whole = df.where(" and ".join(f"{c} is not null" for c in cols))
    with intermediate(df.sparkSession) as keep:
        first = materialise(var_fit(whole, cols, order=long).where("order is not null").select(KEY, "coefficients"), "long")
        rows = _lagged(whole, cols, long).join(first, KEY)
        terms = _terms(cols, long, now=False)
        guess = lambda i: sum((t * F.col("coefficients")[j][i] for j, t in enumerate(terms)), F.lit(0.0))
        rows = rows.where(F.col("t") >= long).withColumns({f"e{i}": F.col(f"{c}_0") - guess(i) for i, c in enumerate(cols)})
        w = W.partitionBy(KEY).orderBy("ts")
        rows = rows.withColumns({f"l{i}": F.lag(f"e{i}").over(w) for i in range(k)}).drop("coefficients")
        shocks = F.max_by(F.array(*(F.col(f"e{i}") for i in range(k))), "t").alias("shock")
        x = [*_terms(cols, p, now=False), *(F.col(f"l{i}") for i in range(k)), *(F.col(f"{c}_0") for c in cols)]
        sums = products(rows, KEY, x, F.col("l0").isNotNull() & (F.col("t") >= long + p), _latest(cols, p), shocks).withColumns({"past": F.col("end.past"), "mean": F.col("end.mean")})

        def path(n: int, g: np.ndarray, past: np.ndarray, mean: np.ndarray, shock: np.ndarray) -> tuple:
            ys = range(len(g) - k, len(g))
            b = np.column_stack([fitted(g, list(range(len(g) - k)), y)[0] for y in ys])
            return (var_path([list(v) for v in past], b[: 1 + p * k], mean, h, shock, b[1 + p * k :]).tolist(),)

        out = solved(sums, KEY, path, "path array<array<double>>", "past", "mean", "shock")
        at = out.select(KEY, F.posexplode("path").alias("h", "v"))
        return keep(at.select(KEY, (F.col("h") + 1).cast("long").alias("h"), *(F.col("v")[i].alias(c) for i, c in enumerate(cols))))


def impulse_responses(df: DataFrame, cols: list[str], order: int, periods: int, structure: np.ndarray) -> DataFrame:
    """(series_id, t, of, shock, response, share): structural responses for structure e = u, and each shock's share of the forecast variance."""
    k = len(cols)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for s, b in zip(pdf[KEY], pdf["coefficients"]):
                b = np.stack(b)
                phi = [b[1 + i * k : 1 + (i + 1) * k].T for i in range(order)]
                psi = [np.linalg.inv(structure)]
                for i in range(1, periods):
                    psi.append(sum(phi[j] @ psi[i - 1 - j] for j in range(min(i, order))))
                psi = np.array(psi)
                total = np.cumsum(psi**2, axis=0)
                t, i, j = np.indices(psi.shape)
                yield pd.DataFrame({KEY: s, "t": t.ravel(), "of": i.ravel(), "shock": j.ravel(), "response": psi.ravel(), "share": (total / total.sum(axis=2, keepdims=True)).ravel()})

    fits = var_fit(df, cols, order=order).where("order is not null")
    return fits.mapInPandas(run, f"{KEY} {dict(df.dtypes)[KEY]}, t long, of long, shock long, response double, share double")

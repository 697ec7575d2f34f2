"""Autocorrelation, residual and stationarity tests, structural breaks."""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.aggregates import histogram, percentiles
from chronoweave.operators.regress import fitted, products, solved
from chronoweave.operators.segments import scan

KEY = "series_id"


def acf(df: DataFrame, nlags: int, centred: bool = True) -> DataFrame:
    """(series_id, lag, r): one window and one aggregate for all lags; raw sums of products if not centred."""
    w = W.partitionBy(KEY).orderBy("ts")
    mean = F.avg("y").over(W.partitionBy(KEY)) if centred else F.lit(0.0)
    x = df.withColumn("x", F.col("y") - mean)
    x = x.withColumns({f"l{k}": F.lag("x", k).over(w) for k in range(nlags + 1)})
    base = F.sum(F.col("x") * F.col("x")) if centred else F.lit(1.0)
    r = x.groupBy(KEY).agg(*(F.try_divide(F.sum(F.col("x") * F.col(f"l{k}")), base).alias(f"r{k}") for k in range(nlags + 1)))
    stack = ", ".join(f"CAST({k} AS BIGINT), r{k}" for k in range(nlags + 1))
    return r.selectExpr(KEY, f"stack({nlags + 1}, {stack}) AS (lag, r)")


def pacf(df: DataFrame, nlags: int) -> DataFrame:
    """(series_id, lag, r) by Durbin and Levinson's recursion on the autocorrelations: one fold over a series' few lags."""
    held = acf(df, nlags).groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda s: s["r"]).alias("r"))
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.lit(1.0).alias("v"), F.array(F.lit(1.0)).alias("out"))

    def step(s, k):  # phi has the k - 1 coefficients of the order before
        dot = F.aggregate(F.zip_with(s["phi"], F.reverse(F.slice("r", F.lit(2), k - 1)), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
        g = F.try_divide(F.element_at("r", k + 1) - dot, s["v"])
        phi = F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - g * b), F.array(g))
        return F.struct(phi.alias("phi"), (s["v"] * (1 - g * g)).alias("v"), F.concat(s["out"], F.array(g)).alias("out"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(nlags)), start, step)["out"]
    return held.select(KEY, F.posexplode(out).alias("lag", "r")).select(KEY, F.col("lag").cast("long").alias("lag"), "r")


def durbin_watson(df: DataFrame, col: str = "e") -> DataFrame:
    step = F.col(col) - F.lag(col).over(W.partitionBy(KEY).orderBy("ts"))
    return df.withColumn("s_", step).groupBy(KEY).agg((F.sum(F.col("s_") ** 2) / F.sum(F.col(col) ** 2)).alias("dw"))


def cusum(df: DataFrame, col: str = "e") -> DataFrame:
    """Cumulated residuals over deviation times root of n; a long series is spread over tasks."""
    line = df.groupBy(F.col(KEY).alias("g_")).agg(F.stddev_samp(col).alias("s_"), F.count(col).alias("n_"))
    d = scan(df, {"t_": ("sum", F.col(col))}).join(line, F.col(KEY).eqNullSafe(F.col("g_")))
    return d.withColumn("cusum", F.col("t_") / (F.col("s_") * F.sqrt("n_"))).drop("t_", "s_", "n_", "g_")


def cusum_test(df: DataFrame, col: str = "e") -> DataFrame:
    """(series_id, sup, p): the largest |cusum| and how likely a Brownian bridge goes that far."""
    top = cusum(df, col).groupBy(KEY).agg(F.max(F.abs("cusum")).alias("sup"))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: 2 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * F.col("sup") * F.col("sup")))
    p = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return top.select(KEY, "sup", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"))


def amoc(df: DataFrame) -> DataFrame:
    """At most one change of the mean: the split with the least sum of squares, its gain and whether it beats 3 log n penalties of variance."""
    line = df.groupBy(F.col(KEY).alias("g_")).agg(F.count("y").alias("n"), F.sum("y").alias("t"), F.var_pop("y").alias("v"))
    d = scan(df, {"k": ("rows", F.lit(1)), "a": ("sum", F.col("y"))}).join(line, F.col(KEY).eqNullSafe(F.col("g_"))).withColumn("k", F.col("k").cast("long"))
    gain = F.pow("a", 2) / F.col("k") + F.pow(F.col("t") - F.col("a"), 2) / (F.col("n") - F.col("k")) - F.pow("t", 2) / F.col("n")
    d = d.where("k < n").withColumn("gain", gain)
    change = F.struct("k", "gain", "n", "v")
    best = d.groupBy(KEY).agg(F.min_by(change, F.struct(-F.round("gain", 6), "k")).alias("b_")).select(KEY, "b_.*")
    return best.select(KEY, "k", "gain", (F.col("gain") > 3 * F.log("n") * F.col("v")).alias("change"))


# Published response-surface coefficients (constant, no trend) for the 1, 5 and 10 % points of the
# Dickey-Fuller distribution and of the Engle-Granger one with two variables: b0 + b1 / n + b2 / n^2.
ADF_POINTS = {0.01: (-3.43035, -6.5393, -16.786), 0.05: (-2.86154, -2.8903, -4.234), 0.10: (-2.56677, -1.5384, -2.809)}
EG_POINTS = {0.01: (-3.89644, -10.9519, -22.527), 0.05: (-3.33613, -6.1101, -6.823), 0.10: (-3.04445, -4.2412, -2.720)}


# Published polynomials of the statistic whose normal distribution function is its approximate p-value (constant, no trend), for one
# series and for the residuals of two: least and largest statistic, the one up to which the first polynomial holds, and both polynomials.
ADF_P = (-18.83, 2.74, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368))
EG_P = (-16.18, 0.92, -2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377))
# The published rational approximation of the error function (to 1.5e-7).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf_column(z: Column) -> Column:
    x = F.abs(z) / 2**0.5
    k = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * sum((c * F.pow(k, F.lit(i + 1)) for i, c in enumerate(ERF)), F.lit(0.0)) * F.exp(-x * x)
    return F.when(z < 0, tail).otherwise(1 - tail)


def unit_root_p(t: Column, table: tuple) -> Column:
    """The approximate p-value of a unit root statistic."""
    low, high, split, small, large = table
    polynomial = lambda cs: sum((c * F.pow(t, F.lit(i)) for i, c in enumerate(cs)), F.lit(0.0))
    p = F.when(t > high, 1.0).when(t < low, 0.0).otherwise(normal_cdf_column(F.when(t <= split, polynomial(small)).otherwise(polynomial(large))))
    return F.when(t.isNotNull(), p)


def _dickey_fuller(df: DataFrame, max_lag: int | None) -> DataFrame:
    """(series_id, statistic, lags, rows): the t value of the level in the regression of differences on it and their lags; lags by AIC on common rows.

    The regressions share one aggregate of sums of products; a series is never held in a task's memory for it. Series too short have no statistic.
    """
    known = df.where("y IS NOT NULL")
    size = known.groupBy(F.col(KEY).alias("s_")).agg(F.count("*").alias("n_"), F.avg("y").alias("m_"))
    most = F.floor(12 * F.pow(F.col("n_") / 100, F.lit(0.25))) if max_lag is None else F.lit(max_lag)
    size = size.withColumn("top", F.least(most, F.greatest(F.lit(0), F.floor(F.col("n_") / 2) - 3)).cast("int"))
    top = size.agg(F.max("top")).first()[0] or 0
    w = W.partitionBy(KEY).orderBy("ts")
    rows = known.join(size, F.col(KEY).eqNullSafe(F.col("s_"))).withColumns({"z_": F.col("y") - F.col("m_"), "d_": F.lead("y").over(w) - F.col("y"), "t_": F.row_number().over(w) - 1})
    rows = rows.withColumns({f"d{k}_": F.lag("d_", k).over(w) for k in range(1, top + 1)})
    cols = [F.lit(1.0), F.col("z_"), *(F.col(f"d{k}_") for k in range(1, top + 1)), F.col("d_")]
    sums = products(rows, KEY, cols, (F.col("t_") >= F.col("top")) & F.col("d_").isNotNull(), F.first("top").alias("top"))

    def choose(n: int, g: np.ndarray, top: int) -> tuple:
        best = (np.inf, None, 0)
        for p in range(top + 1):
            x = list(range(p + 2))
            if n <= len(x):
                break
            b, rest = fitted(g, x, len(g) - 1)
            aic = n * log(max(rest / n, 1e-300)) + 2 * len(x)
            spread = rest / (n - len(x)) * np.linalg.pinv(g[np.ix_(x, x)])[1, 1]
            best = min(best, (aic, float(b[1] / np.sqrt(max(spread, 1e-300))), p), key=lambda r: r[0])
        return best[1], best[2], n

    return solved(sums, KEY, choose, "statistic double, lags long, rows long", "top")


def _points(table: dict, level: float) -> Column:
    a, b, c = table[level]
    return a + b / F.col("rows") + c / F.pow("rows", F.lit(2))


def adf(df: DataFrame, max_lag: int | None = None) -> DataFrame:
    """(series_id, statistic, lags, p, crit_1, crit_5, crit_10, stationary at 5 %); the statistic of a constant or very short series is NULL or without meaning."""
    t = F.col("statistic")
    crit = {f"crit_{n}": _points(ADF_POINTS, n / 100) for n in (1, 5, 10)}
    out = _dickey_fuller(df, max_lag).withColumns({"p": unit_root_p(t, ADF_P), **crit}).withColumn("stationary", t < F.col("crit_5"))
    return out.select(KEY, "statistic", "lags", "p", *crit, "stationary")


def cointegration(pairs: DataFrame) -> DataFrame:
    """Engle and Granger's test of (series_id, ts, y, x): statistic of the residuals of y on x, its lags, p and the 5 % point."""
    known = pairs.where("y IS NOT NULL AND x IS NOT NULL")
    line = known.groupBy(F.col(KEY).alias("r_")).agg(F.regr_slope("y", "x").alias("b_"), F.regr_intercept("y", "x").alias("a_"))
    rest = known.join(line, F.col(KEY).eqNullSafe(F.col("r_"))).select(KEY, "ts", (F.col("y") - F.col("a_") - F.col("b_") * F.col("x")).alias("y"))
    t = F.col("statistic")
    out = _dickey_fuller(rest, None).withColumns({"p": unit_root_p(t, EG_P), "crit_5": _points(EG_POINTS, 0.05)})
    return out.select(KEY, "statistic", "lags", "p", "crit_5", (t < F.col("crit_5")).alias("cointegrated"))


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    f = d
    for m in range(1, 200):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * f


def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f)."""
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def granger(pairs: DataFrame, lags: int = 2) -> DataFrame:
    """Whether lags of x help to explain y of (series_id, ts, y, x): F, p and p < 0.05, from one aggregate of sums of products."""
    known = pairs.where("y IS NOT NULL AND x IS NOT NULL")
    mean = known.groupBy(F.col(KEY).alias("s_")).agg(F.avg("y").alias("my_"), F.avg("x").alias("mx_"))
    w = W.partitionBy(KEY).orderBy("ts")
    rows = known.join(mean, F.col(KEY).eqNullSafe(F.col("s_"))).withColumns({"y_": F.col("y") - F.col("my_"), "x_": F.col("x") - F.col("mx_")})
    rows = rows.withColumns({f"{c}{k}_": F.lag(f"{c}_", k).over(w) for c in "yx" for k in range(1, lags + 1)})
    cols = [F.lit(1.0), *(F.col(f"{c}{k}_") for c in "yx" for k in range(1, lags + 1)), F.col("y_")]

    def test(n: int, g: np.ndarray) -> tuple:
        free = n - 2 * lags - 1
        if free < 1:
            return None, None, None
        short, full = (fitted(g, list(range(1 + k)), len(g) - 1)[1] for k in (lags, 2 * lags))
        f = ((short - full) / lags) / max(full / free, 1e-300)
        p = f_tail(float(f), lags, free)
        return float(f), p, p < 0.05

    return solved(products(rows, KEY, cols, F.col(f"x{lags}_").isNotNull()), KEY, test, "f double, p double, causes boolean")


def residual_panel(df: DataFrame, bins: int = 20, nlags: int = 10, quantiles: int = 20, col: str = "e") -> DataFrame:
    """What a residual plot shows, as rows (series_id, kind, k, value): density by bin, autocorrelation by lag, quantiles k / quantiles.

    Residuals are standardised for the density and the quantiles.
    """
    line = df.groupBy(F.col(KEY).alias("s_")).agg(F.avg(col).alias("m_"), F.stddev_samp(col).alias("d_"))
    z = df.join(line, F.col(KEY).eqNullSafe(F.col("s_"))).select(KEY, "ts", F.col(col).alias("y"), F.try_divide(F.col(col) - F.col("m_"), F.col("d_")).alias("z"))
    named = lambda kind, k, value: [KEY, F.lit(kind).alias("kind"), F.col(k).cast("long").alias("k"), F.col(value).alias("value")]
    density = histogram(z, bins, col="z", snap=6).select(*named("density", "bin", "density"))
    lagged = acf(z.select(KEY, "ts", "y"), nlags).select(*named("acf", "lag", "r"))
    names = {str(k): k / quantiles for k in range(1, quantiles)}
    spread = percentiles(z, names, col="z").unpivot([KEY], list(names), "k", "q").select(*named("quantile", "k", "q"))
    return density.unionByName(lagged).unionByName(spread)


def random_effects(df: DataFrame, entity: str, x: str, y: str) -> DataFrame:
    """Random-effects line of y on x over a panel, one row: slope, intercept, theta (mean share of the entity means taken off), var_within, var_entity.

    The variances come from the within and the between regression; an entity of T rows
    loses theta = 1 - sqrt(within / (within + T * entity)) of its means. All sums are
    by entity, so the rows are read and shuffled once, as partial sums. Rows that lack
    x or y don't count; too few entities or rows give NULLs.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    each = rows.groupBy(entity).agg(
        F.count("*").alias("t"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_pop(x) * F.count("*")).alias("xx"), (F.var_pop(y) * F.count("*")).alias("yy"), (F.covar_pop(x, y) * F.count("*")).alias("xy")
    )
    total = each.agg(
        F.sum("t").alias("n"), F.count("*").alias("g"), F.sum(1 / F.col("t")).alias("inv"), F.sum("xx").alias("wxx"), F.sum("yy").alias("wyy"), F.sum("xy").alias("wxy"),
        F.var_pop("mx").alias("bxx"), F.var_pop("my").alias("byy"), F.covar_pop("mx", "my").alias("bxy"),
    )
    within = F.try_divide(F.col("wyy") - F.try_divide(F.col("wxy") * F.col("wxy"), F.col("wxx")), F.when(F.col("n") > F.col("g") + 1, F.col("n") - F.col("g") - 1))
    between = F.try_divide((F.col("byy") - F.try_divide(F.col("bxy") * F.col("bxy"), F.col("bxx"))) * F.col("g"), F.when(F.col("g") > 2, F.col("g") - 2))
    total = total.select(within.alias("var_within"), F.greatest(F.lit(0.0), between - within * F.col("inv") / F.col("g")).alias("var_entity"))
    spread = F.col("var_within") + F.col("t") * F.col("var_entity")
    d = each.join(F.broadcast(total)).withColumn("theta", F.when(spread == 0, 0.0).otherwise(1 - F.sqrt(F.try_divide(F.col("var_within"), spread))))
    d = d.withColumn("w", F.col("t") * (1 - F.col("theta")) * (1 - F.col("theta")))
    s = d.agg(
        F.sum("w").alias("s"), F.sum(F.col("w") * F.col("mx")).alias("sx"), F.sum(F.col("w") * F.col("my")).alias("sy"),
        F.sum(F.col("xx") + F.col("w") * F.col("mx") * F.col("mx")).alias("sxx"), F.sum(F.col("xy") + F.col("w") * F.col("mx") * F.col("my")).alias("sxy"),
        F.avg("theta").alias("theta"), F.max("var_within").alias("var_within"), F.max("var_entity").alias("var_entity"),
    )
    s = s.withColumn("slope", F.try_divide(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")))
    return s.select("slope", F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), F.col("s")).alias("intercept"), "theta", "var_within", "var_entity")

"""Nonlinear dynamics, state-space filters, multivariate models, simulation and sampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.models import arima_fit, arima_path, design, minimise, ols

KEY = "series_id"


def per_series(df: DataFrame, f: Callable[[np.ndarray], pd.DataFrame], schema: str, *cols: str) -> DataFrame:
    """f on the values of one series in order of time (one column, or rows of several); its rows get the series' id."""
    cols = cols or ("y",)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        v = pdf[list(cols)].to_numpy(float)
        out = f(v[:, 0] if len(cols) == 1 else v)
        out.insert(0, KEY, pdf[KEY].iloc[0])
        return out

    return df.dropna(subset=list(cols)).groupBy(KEY).applyInPandas(run, f"series_id string, {schema}")


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Squared differences along the cheapest alignment; rows are filled by anti-diagonals."""
    n, m = len(a), len(b)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0.0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        cost[i, j] = (a[i - 1] - b[j - 1]) ** 2 + np.minimum(np.minimum(cost[i - 1, j], cost[i, j - 1]), cost[i - 1, j - 1])
    return float(cost[n, m])


def garch(r: np.ndarray, arch_only: bool = False) -> np.ndarray:
    """omega, alpha, beta by Gaussian quasi-likelihood (beta 0 for ARCH(1))."""
    e = r - r.mean()
    v = e.var()

    def unpack(w):
        a, b = 0.999 / (1 + np.exp(-w[1])), 0.0 if arch_only else 1 / (1 + np.exp(-w[2]))
        return np.exp(w[0]) * v, a, (0.999 - a) * b

    def loss(w):
        o, a, b = unpack(w)
        s = np.empty(len(e))
        s[0] = v
        for t in range(1, len(e)):
            s[t] = o + a * e[t - 1] ** 2 + b * s[t - 1]
        return float(np.sum(np.log(s) + e**2 / s))

    return np.array(unpack(minimise(loss, np.array([-1.0, -2.0, 1.0][: 2 if arch_only else 3]), 150, 0.5)))


def variance_path(r: np.ndarray, w: np.ndarray, h: int) -> np.ndarray:
    """Forecast variances of a GARCH(1, 1), which tend to omega / (1 - alpha - beta)."""
    o, a, b = w
    e, s = r - r.mean(), r.var()
    for x in e:
        s = o + a * x * x + b * s
    out = [s]
    for _ in range(h - 1):
        out.append(o + (a + b) * out[-1])
    return np.array(out)


def gibbs_change(y: np.ndarray, steps: int = 1000, burn: int = 200, seed: int = 1) -> pd.DataFrame:
    """Poisson rates before and after one change and its place, by Gibbs sampling; means after the burn-in."""
    rng, n = np.random.default_rng(seed), len(y)
    head = np.cumsum(y)
    b1 = b2 = 1.0
    k, kept, at = n // 2, [], np.arange(1, n + 1)
    for i in range(steps):
        mu = rng.gamma(0.5 + head[k - 1], 1 / (k + b1))
        lam = rng.gamma(0.5 + head[-1] - head[k - 1], 1 / (n - k + b2))
        b1, b2 = rng.gamma(0.5, 1 / (mu + 1)), rng.gamma(0.5, 1 / (lam + 1))
        ll = (lam - mu) * at + head * np.log(max(mu, 1e-300) / max(lam, 1e-300))
        p = np.exp(ll - ll.max())
        k = min(int(np.searchsorted(np.cumsum(p / p.sum()), rng.random())) + 1, n - 1)
        if i >= burn:
            kept.append((k, mu, lam))
    m = np.mean(kept, axis=0)
    return pd.DataFrame({"change_at": [m[0]], "rate_before": [m[1]], "rate_after": [m[2]]})


def bayes_ar(y: np.ndarray, draws: int = 1000, tune: int = 200, seed: int = 1) -> pd.DataFrame:
    """AR(1) with flat priors: draws of intercept, slope and deviation; means and 95 % bands."""
    rng = np.random.default_rng(seed)
    x, want = design(y, [1])
    b, e = ols(x, want)
    inv = np.linalg.pinv(x.T @ x)
    s2, kept = e.var(), []
    for i in range(draws + tune):
        w = rng.multivariate_normal(b, s2 * inv)
        u = want - x @ w
        s2 = (u @ u / 2) / rng.gamma(len(u) / 2)
        if i >= tune:
            kept.append((*w, s2**0.5))
    kept = np.array(kept)
    lo, hi = np.percentile(kept, [2.5, 97.5], axis=0)
    return pd.DataFrame({"parameter": ["intercept", "slope", "sigma"], "mean": kept.mean(axis=0), "lo": lo, "hi": hi})


def random_walk_posterior(y: np.ndarray) -> pd.DataFrame:
    """A Gaussian random walk seen through noise: filtered and smoothed mean with a 95 % band; variances by likelihood."""

    def run(q, r):
        m, p, ms, ps, ll = y[0], r, [], [], 0.0
        for z in y:
            s = p + q + r
            ll -= 0.5 * (np.log(s) + (z - m) ** 2 / s)
            k = (p + q) / s
            m, p = m + k * (z - m), (1 - k) * (p + q)
            ms.append(m), ps.append(p)
        return np.array(ms), np.array(ps), ll

    v = np.diff(y).var() + 1e-12
    w = minimise(lambda w: -run(v * np.exp(w[0]), v * np.exp(w[1]))[2], np.array([-1.0, -1.0]), 80, 0.5)
    q, r = v * np.exp(w)
    m, p, _ = run(q, r)
    for t in range(len(y) - 2, -1, -1):
        g = p[t] / (p[t] + q)
        m[t], p[t] = m[t] + g * (m[t + 1] - m[t]), p[t] + g * g * (p[t + 1] - p[t] - q)
    sd = 1.96 * np.sqrt(np.maximum(p, 0))
    return pd.DataFrame({"t": np.arange(len(y)), "mean": m, "lo": m - sd, "hi": m + sd})


def impute(y: np.ndarray, most: int = 10, tol: float = 1e-3, seed: int = 1) -> np.ndarray:
    """Gaps filled with the mean, then again and again with normal draws until they settle; the last fill is returned."""
    gap, rng = np.isnan(y), np.random.default_rng(seed)
    out = np.where(gap, np.nanmean(y), y)
    for _ in range(most if gap.any() else 0):
        new = out.copy()
        new[gap] = rng.normal(out.mean(), out.std(), gap.sum())
        done = np.linalg.norm(new - out) < tol
        out = new
        if done:
            break
    return out


def cubic_fill(y: np.ndarray) -> np.ndarray:
    """Gaps by a natural cubic spline through the known values; after the last one its value, before the first NaN."""
    x = np.flatnonzero(~np.isnan(y))
    if len(x) < 3:
        return pd.Series(y).interpolate().to_numpy()
    v, h = y[x], np.diff(x).astype(float)
    n = len(x)
    a = np.zeros((n, n))
    a[0, 0] = a[-1, -1] = 1
    rhs = np.zeros(n)
    i = np.arange(1, n - 1)
    a[i, i - 1], a[i, i], a[i, i + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    rhs[1:-1] = 6 * (np.diff(v)[1:] / h[1:] - np.diff(v)[:-1] / h[:-1])
    m = np.linalg.solve(a, rhs)
    out = y.copy()
    t = np.arange(x[0], x[-1] + 1)
    k = np.clip(np.searchsorted(x, t, side="right") - 1, 0, n - 2)
    u, w = x[k + 1] - t, t - x[k]
    out[t] = (m[k] * u**3 + m[k + 1] * w**3) / (6 * h[k]) + (v[k] / h[k] - m[k] * h[k] / 6) * u + (v[k + 1] / h[k] - m[k + 1] * h[k] / 6) * w
    out[x] = v
    out[x[-1] :] = v[-1]
    return out


def savgol(y: np.ndarray, window: int, order: int = 3) -> np.ndarray:
    """Polynomial smoothing; the ends take the polynomial of the first and last full window."""
    window += 1 - window % 2
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    fit = basis @ np.linalg.pinv(basis)
    out = np.convolve(y, fit[half][::-1], mode="same")
    out[:half], out[-half:] = (fit @ y[:window])[:half], (fit @ y[-window:])[-half:]
    return out


def robust_decompose(y: np.ndarray, period: int) -> pd.DataFrame:
    """Savitzky-Golay trend (window period // 2 + 1, order 3), medians of the slots, residuals."""
    trend = savgol(y, max(period // 2 + 1, 5))
    d = y - trend
    slot = np.arange(len(y)) % period
    med = np.array([np.median(d[slot == k]) for k in range(period)])
    return pd.DataFrame({"t": np.arange(len(y)), "trend": trend, "seasonal": med[slot], "resid": d - med[slot]})


def bootstrap_band(y: np.ndarray, h: int, n: int = 50, level: float = 0.95, seed: int = 1) -> pd.DataFrame:
    """Percentiles of paths from resampled residuals of one ARIMA(1, 1, 1); order in time is kept."""
    rng, m = np.random.default_rng(seed), arima_fit(y, 1, 1, 1)
    paths = np.array([arima_path(y, m, h, rng.choice(m["e"][2:], h)) for _ in range(n)])
    lo, hi = np.percentile(paths, [50 * (1 - level), 50 * (1 + level)], axis=0)
    return pd.DataFrame({"h": np.arange(1, h + 1), "mean": paths.mean(axis=0), "lo": lo, "hi": hi})


def business_days(spark: SparkSession, last: str, end: str) -> DataFrame:
    """Business days after last up to end, numbered from 1; an error where there is none."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{last}' + INTERVAL 1 DAY, DATE'{end}')) AS d").where(F.weekday("d") < 5) if end > last else None
    if days is None or days.isEmpty():
        raise ValueError(f"no business day after {last} up to {end}")
    return days.withColumn("step", F.row_number().over(W.orderBy("d")))


def monte_carlo(spark: SparkSession, prices: DataFrame, end: str, iterations: int = 1000, seed: int = 7) -> DataFrame:
    """Geometric Brownian paths (d, path_id, price) from the last price on, by business day to end; step 0 is the anchor.

    Drift and deviation of the log returns are one aggregate. A shock is a normal
    quantile of a hash of path, step and seed, so that paths don't depend on how
    rows are dealt out; a path's prices are exponentials of one running sum.
    """
    w = W.partitionBy(KEY).orderBy("ts")
    r = prices.withColumn("r", F.log(F.col("y") / F.lag("y").over(w)))
    s = r.agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.max_by("y", "ts").alias("last"), F.max("ts").cast("date").cast("string").alias("day")).first()
    drift, sigma = s["m"] - 0.5 * s["s"] ** 2, s["s"]
    days = F.broadcast(business_days(spark, s["day"], end))
    unit = lambda k: (F.pmod(F.xxhash64("path_id", "step", F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    normal = F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * np.pi * unit(1))
    n = days.count()
    at = spark.range(iterations * n).select(F.expr(f"id div {n}").alias("path_id"), (F.col("id") % n + 1).alias("step"))
    steps = at.join(days, "step")
    run = W.partitionBy("path_id").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    walk = steps.withColumn("price", s["last"] * F.exp(F.sum(drift + sigma * normal).over(run)))
    anchor = spark.range(iterations).select(F.lit(s["day"]).cast("date").alias("d"), F.lit(0).alias("step"), F.col("id").alias("path_id"), F.lit(s["last"]).alias("price"))
    return anchor.unionByName(walk).select("d", "path_id", "step", "price")


def lorenz(n: int = 10_000, dt: float = 0.01, s: float = 10.0, r: float = 28.0, b: float = 8 / 3) -> np.ndarray:
    """x(t), y(t), z(t) from (1, 1, 1) by Runge and Kutta's method."""
    f = lambda u: np.array([s * (u[1] - u[0]), u[0] * (r - u[2]) - u[1], u[0] * u[1] - b * u[2]])
    out = np.empty((n, 3))
    u = np.ones(3)
    for i in range(n):
        out[i] = u
        k1 = f(u)
        k2 = f(u + dt / 2 * k1)
        k3 = f(u + dt / 2 * k2)
        u = u + dt / 6 * (k1 + 2 * k2 + 2 * k3 + f(u + dt * k3))
    return out


def simulate_var(n: int, a: np.ndarray, seed: int = 1) -> np.ndarray:
    rng, out = np.random.default_rng(seed), np.zeros((n, len(a)))
    for t in range(1, n):
        out[t] = a @ out[t - 1] + rng.standard_normal(len(a))
    return out


def simulate_arch(n: int, omega: float = 0.1, alpha: float = 0.5, seed: int = 1) -> np.ndarray:
    """Returns whose variance follows the last shock."""
    z = np.random.default_rng(seed).standard_normal(n)
    return z * np.sqrt(omega + alpha * np.concatenate([[0.0], z[:-1] ** 2]))


def synthetic(spark: SparkSession, n: int, low: float = 10.0, high: float = 50.0, amplitude: float = 10.0, period: int = 30, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """Daily linear trend plus sine plus normal noise, made where the rows are."""
    i = F.col("id")
    eps = F.randn(seed) * noise if noise else F.lit(0.0)
    y = low + (high - low) * i / max(n - 1, 1) + amplitude * F.sin(2 * np.pi * i / period) + eps
    return spark.range(n).select(F.lit("synthetic").alias(KEY), F.expr("TIMESTAMP_NTZ'2020-01-01' + make_dt_interval(CAST(id AS INT))").alias("ts"), y.alias("y"))


def terminal(df: DataFrame, col: str = "price", width: float = 0.67) -> DataFrame:
    """Of final values: number, mean, deviation, mean -/+ width deviations and the share of values between them."""
    line = df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("sd"))
    line = line.withColumns({"lower": F.col("mean") - width * F.col("sd"), "upper": F.col("mean") + width * F.col("sd")})
    inside = F.avg(F.col(col).between(F.col("lower"), F.col("upper")).cast("double"))
    return df.select(col).join(F.broadcast(line)).groupBy("n", "mean", "sd", "lower", "upper").agg(inside.alias("inside"))

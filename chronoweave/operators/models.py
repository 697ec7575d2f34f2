"""Forecasting models: numpy fits, one series a group, spread over the cluster by series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "series_id"
FORECAST = "series_id string, model string, h long, yhat double, lo double, hi double, status string"
Z90 = 1.6448536269514722  # the 0.95 quantile of the normal distribution

#: A model takes the values in order and a horizon and gives the mean path and the residuals' deviation at each step.
Model = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def design(z: np.ndarray, lags: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (1, z[t - k] for each lag) and their z[t]."""
    m = max(lags)
    cols = [np.ones(len(z) - m)] + [z[m - k : len(z) - k] for k in lags]
    return np.column_stack(cols), z[m:]


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return b, y - x @ b


def minimise(f: Callable[[np.ndarray], float], x0: np.ndarray, steps: int = 400, size: float = 0.1) -> np.ndarray:
    """Nelder and Mead's simplex search from a fixed start, hence the same result each time."""
    n = len(x0)
    s = np.vstack([x0, x0 + size * np.eye(n)])
    v = np.array([f(p) for p in s])
    for _ in range(steps):
        o = np.argsort(v, kind="stable")
        s, v = s[o], v[o]
        if v[-1] - v[0] < 1e-10 * (1 + abs(v[0])):
            break
        c = s[:-1].mean(axis=0)
        r = 2 * c - s[-1]
        fr = f(r)
        if fr < v[0]:
            e = 3 * c - 2 * s[-1]
            fe = f(e)
            s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            s[-1], v[-1] = r, fr
        else:
            k = (c + s[-1]) / 2 if fr >= v[-1] else (c + r) / 2
            fk = f(k)
            if fk < min(fr, v[-1]):
                s[-1], v[-1] = k, fk
            else:
                s[1:] = (s[1:] + s[0]) / 2
                v[1:] = [f(p) for p in s[1:]]
    return s[int(np.argmin(v))]


def sparse_ar(lags: tuple[int, ...] = (1, 2, 4, 8)) -> Model:
    """Regression of the differences on some of their lags; the forecast is summed up onto the last value."""

    def fit(y: np.ndarray, h: int):
        z = np.diff(y)
        b, e = ols(*design(z, list(lags)))
        past = list(z)
        for _ in range(h):
            past.append(b[0] + sum(c * past[-k] for c, k in zip(b[1:], lags)))
        return y[-1] + np.cumsum(past[len(z) :]), e.std() * np.sqrt(np.arange(1, h + 1))

    return fit


def arma_residuals(z: np.ndarray, c: float, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Innovations given zeros before the start (conditional sum of squares)."""
    e = np.zeros(len(z))
    p, q = len(phi), len(theta)
    ar = z - c
    for k in range(1, p + 1):
        ar[k:] -= phi[k - 1] * z[:-k]
    for t in range(p, len(z)):
        e[t] = ar[t] - sum(theta[k - 1] * e[t - k] for k in range(1, min(q, t) + 1))
    return e


def arima_fit(y: np.ndarray, p: int, d: int, q: int) -> dict:
    """Conditional least squares; the start is Hannan and Rissanen's two-step regression."""
    z = np.diff(y, d) if d else y.astype(float)
    if len(z) < 3 * (p + q + 2):
        raise ValueError("too few values")
    long = max(p + q + 1, 4)
    _, e0 = ols(*design(z, list(range(1, long + 1))))
    m = max(p, q, 1)
    tail = z[long:]
    n = len(tail) - m
    cols = [np.ones(n)] + [tail[m - k : m - k + n] for k in range(1, p + 1)] + [e0[m - k : m - k + n] for k in range(1, q + 1)]
    start, _ = ols(np.column_stack(cols), tail[m:])
    start = np.concatenate([start[:1], np.clip(start[1:], -0.95, 0.95)])

    def loss(w: np.ndarray) -> float:
        if np.abs(w[1:]).max(initial=0) > 2:
            return 1e300
        e = arma_residuals(z, w[0], w[1 : p + 1], w[p + 1 :])
        s = float(e @ e)
        return s if np.isfinite(s) else 1e300

    w = minimise(loss, start, 60 * (p + q + 1)) if q else start
    e = arma_residuals(z, w[0], w[1 : p + 1], w[p + 1 :])
    n, k = len(z), p + q + 2
    var = float(e @ e) / n
    aicc = n * np.log(max(var, 1e-300)) + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)
    return {"c": w[0], "phi": w[1 : p + 1], "theta": w[p + 1 :], "d": d, "e": e, "z": z, "sigma": var**0.5, "aicc": aicc, "order": (p, d, q)}


def arima_path(y: np.ndarray, m: dict, h: int, shocks: np.ndarray | None = None) -> np.ndarray:
    """The forecast, or with shocks (one each step) a path that could happen."""
    z, e = list(m["z"]), list(m["e"])
    for i in range(h):
        new = 0.0 if shocks is None else shocks[i]
        z.append(m["c"] + sum(f * z[-k] for k, f in enumerate(m["phi"], 1)) + sum(t * e[-k] for k, t in enumerate(m["theta"], 1)) + new)
        e.append(new)
    out = np.array(z[len(m["z"]) :])
    for k in range(m["d"], 0, -1):
        out = np.diff(y, k - 1)[-1] + np.cumsum(out)
    return out


def _psi(m: dict, h: int) -> np.ndarray:
    """Weights of past shocks in the forecast error, of differences summed up d times."""
    psi = np.zeros(h)
    psi[0] = 1.0
    for j in range(1, h):
        psi[j] = (m["theta"][j - 1] if j <= len(m["theta"]) else 0.0) + sum(f * psi[j - k] for k, f in enumerate(m["phi"], 1) if j >= k)
    for _ in range(m["d"]):
        psi = np.cumsum(psi)
    return psi


def arima(p: int = 1, d: int = 1, q: int = 1) -> Model:
    def fit(y: np.ndarray, h: int):
        m = arima_fit(y, p, d, q)
        return arima_path(y, m, h), m["sigma"] * np.sqrt(np.cumsum(_psi(m, h) ** 2))

    return fit


#: A search of auto-ARIMA: season (1: none), differences, seasonal differences.
Spec = tuple[int, int, int]


def arima_specs(max_d: int = 2, seasons: tuple[int, ...] = (4, 7, 24)) -> list[Spec]:
    return [(1, d, 0) for d in range(max_d + 1)] + [(s, d, k) for s in seasons for d in range(max_d + 1) for k in (0, 1)]


def lag_polynomial(coefs: np.ndarray, step: int = 1) -> np.ndarray:
    """1 + coefs[0] B^step + coefs[1] B^(2 step) + ..."""
    out = np.zeros(len(coefs) * step + 1)
    out[0], out[step::step] = 1.0, coefs
    return out


def divide(x: np.ndarray, coefs: np.ndarray, step: int = 1, block: int = 32) -> np.ndarray:
    """e with e[t] + sum(coefs[k - 1] * e[t - k * step]) = x[t] and zeros before the start, in blocks; x may have several columns."""
    q, rows = len(coefs), -(-len(x) // step)
    if not q or not x.size:
        return x
    wide = x.reshape(len(x), -1)
    v = np.zeros((rows * step, wide.shape[1]))
    v[: len(x)] = wide
    v = v.reshape(rows, -1)  # the step interleaved series side by side
    size = min(block, rows)
    psi = np.zeros(size)
    psi[0] = 1.0
    for j in range(1, size):
        m = min(j, q)
        psi[j] = -(coefs[:m] @ psi[j - m : j][::-1])
    i = np.arange(size)
    solve = np.where(i[:, None] >= i, psi[np.abs(i[:, None] - i)], 0.0)
    carry = np.zeros((size, q))  # what the last q values (newest first) add to a block's first rows
    for j in range(min(q, size)):
        carry[j, : q - j] = coefs[j:]
    carry = solve @ carry
    e, last = np.zeros(v.shape), np.zeros((q, v.shape[1]))
    for at in range(0, rows, size):
        n = min(size, rows - at)
        e[at : at + n] = solve[:n, :n] @ v[at : at + n] - carry[:n] @ last
        last = np.concatenate([e[at : at + n][::-1], last])[:q]
    return e.reshape(rows * step, -1)[: len(x)].reshape(x.shape)


def sarima_fit(y: np.ndarray, spec: Spec, order: tuple[int, int, int, int, int], skip: int) -> dict:
    """Conditional least squares of ARIMA(p, d, q)(P, D, Q)[season] with or without a constant; order is (p, q, P, Q, constant).

    Errors are counted from value skip on, whatever the order, so that the corrected AIC of all orders
    is about the same values. Raises ValueError where there are too few values or where a root of one of the
    polynomials is within 1.01 of zero.
    """
    (season, d, ds), (p, q, sp, sq, const) = spec, order
    ends = np.cumsum([const, p, q, sp, sq])
    k, n = int(ends[-1]), len(y) - skip
    if n < 3 * (k + 1):
        raise ValueError("too few values")
    gone = np.ones(1)
    for _ in range(d):
        gone = np.convolve(gone, [1.0, -1.0])
    for _ in range(ds):
        gone = np.convolve(gone, lag_polynomial(np.array([-1.0]), season))
    z = np.convolve(y, gone, "valid")

    def split(w):
        return (w[0] if const else 0.0), w[ends[0] : ends[1]], w[ends[1] : ends[2]], w[ends[2] : ends[3]], w[ends[3] :]

    def errors(w):
        c, phi, theta_, sphi, stheta = split(w)
        ar = np.convolve(lag_polynomial(-phi), lag_polynomial(-sphi, season))
        e = divide(divide(np.convolve(z, ar, "valid") - c, stheta, season), theta_)
        return e[len(e) - n :], e

    def slopes(w, e):
        """The derivatives of the errors: those of the constant and the lags of z go through the same division as the errors."""
        c, phi, theta_, sphi, stheta = split(w)
        m, whole = len(e), lambda x, lag: x[len(x) - lag - len(e) : len(x) - lag]
        zs, zp = np.convolve(z, lag_polynomial(-sphi, season), "valid"), np.convolve(z, lag_polynomial(-phi), "valid")
        of = lambda cols: divide(divide(np.column_stack(cols), stheta, season), theta_) if cols else np.empty((m, 0))
        late = lambda x, lags: np.column_stack([np.concatenate([np.zeros(min(i, m)), x[: max(m - i, 0)]]) for i in lags]) if lags else np.empty((m, 0))
        lags = of([np.ones(m)] * const + [whole(zs, i) for i in range(1, p + 1)] + [whole(zp, season * i) for i in range(1, sp + 1)])
        plain = late(divide(e, theta_), list(range(1, q + 1)))
        seasonal = late(divide(e, stheta, season), [season * i for i in range(1, sq + 1)])
        return -np.column_stack([lags[:, : const + p], plain, lags[:, const + p :], seasonal])[m - n :]

    def loss(w):
        with np.errstate(all="ignore"):
            e = errors(w)[0]
            v = float(e @ e)
        return v if np.isfinite(v) else np.inf

    def start():
        """Hannan and Rissanen's regression on lags and on the errors of a long autoregression."""
        far = max(p, q, 1, season * max(sp, sq))
        longer = [*range(1, max(p + q, 4) + 1), *([season * i for i in range(1, sp + sq + 1) if season * i > max(p + q, 4)])]
        if len(z) - max(longer) - far < 3 * (k + len(longer)):
            return np.zeros(k)
        e0 = ols(*design(z, longer))[1]
        tail = z[len(z) - len(e0) :]
        at = np.arange(far, len(tail))
        cols = [np.ones(len(at))] * const + [tail[at - i] for i in range(1, p + 1)] + [e0[at - i] for i in range(1, q + 1)]
        cols += [tail[at - season * i] for i in range(1, sp + 1)] + [e0[at - season * i] for i in range(1, sq + 1)]
        w = ols(np.column_stack(cols), tail[at])[0]
        w[const:] = np.clip(w[const:], -0.9, 0.9)
        return w

    w = np.zeros(k)
    if k:
        w = min((start(), w), key=loss)
        best, damp = loss(w), 1e-3
        for _ in range(40):  # Levenberg and Marquardt
            e, path = errors(w)
            slope = slopes(w, path)
            g, h = slope.T @ e, slope.T @ slope
            if not np.isfinite(h).all():
                break
            before = best
            while damp < 1e6:
                new = w - np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), g, rcond=None)[0]
                if (v := loss(new)) < best:
                    w, best, damp = new, v, damp / 10
                    break
                damp *= 10
            if before - best <= 1e-7 * before:
                break
    c, phi, theta_, sphi, stheta = split(w)
    for poly in (-phi, theta_, -sphi, stheta):
        if len(poly) and np.abs(np.roots(lag_polynomial(poly)[::-1])).min(initial=np.inf) < 1.01:
            raise ValueError("a root within 1.01")
    tail, e = errors(w)
    var = float(tail @ tail) / n
    if not np.isfinite(var):
        raise ValueError("not finite")
    m = k + 1
    aicc = n * np.log(max(var, 1e-300)) + 2 * m + 2 * m * (m + 1) / max(n - m - 1, 1)
    ar = np.convolve(np.convolve(lag_polynomial(-phi), lag_polynomial(-sphi, season)), gone)
    ma = np.convolve(lag_polynomial(theta_), lag_polynomial(stheta, season))
    return {"order": (p, d, q), "seasonal": (sp, ds, sq, season), "c": c, "ar": ar, "ma": ma, "e": e, "sigma": var**0.5, "aicc": aicc}


def sarima_path(y: np.ndarray, m: dict, h: int) -> tuple[np.ndarray, np.ndarray]:
    """The forecast and its error's deviation at each step, from the whole lag polynomials."""
    ar, ma = m["ar"], m["ma"]
    n, back = len(y), max(len(m["ar"]), len(m["ma"]))
    v = np.concatenate([np.zeros(back), y, np.zeros(h)])
    e = np.concatenate([np.zeros(back + n - len(m["e"])), m["e"], np.zeros(h)])
    psi = np.zeros(back + h)
    for i in range(h):
        t, j = back + n + i, back + i
        v[t] = m["c"] - ar[1:] @ v[t - len(ar) + 1 : t][::-1] + ma[1:] @ e[t - len(ma) + 1 : t][::-1]
        psi[j] = (ma[i] if i < len(ma) else 0.0) - ar[1:] @ psi[j - len(ar) + 1 : j][::-1]
    return v[back + n :], m["sigma"] * np.sqrt(np.cumsum(psi[back:] ** 2))


def arima_skip(n: int, specs: list[Spec], max_p: int = 5, max_seasonal: int = 2) -> tuple[int, list[Spec]]:
    """The first value whose error counts and the specs that a series of n values can hold: a season needs 40 values beyond what its lags use up."""
    lost = lambda s: s[1] + max_p + (s[0] * (1 + max_seasonal) if s[0] > 1 else 0)
    held = [s for s in specs if s[0] == 1 or n - lost(s) >= 40]
    return max((lost(s) for s in held), default=0), held


def arima_search(y: np.ndarray, spec: Spec, skip: int, max_p: int = 5, max_q: int = 5, max_seasonal: int = 2) -> dict:
    """Hyndman and Khandakar's stepwise search: the neighbour with the least corrected AIC is taken until none is better."""
    season, d, ds = spec
    top, seasonal = (max_p, max_q, max_seasonal, max_seasonal), season > 1
    seen: dict[tuple, dict | None] = {}

    def tried(orders) -> None:
        for o in orders:
            if o in seen or any(v < 0 or v > t for v, t in zip(o, top)) or (o[4] and d + ds > 1) or (not seasonal and o[2] + o[3]):
                continue
            try:
                seen[o] = sarima_fit(y, spec, o, skip)
            except (ValueError, np.linalg.LinAlgError):
                seen[o] = None

    s, c = int(seasonal), int(d + ds <= 1)
    tried([(2, 2, s, s, c), (0, 0, 0, 0, c), (1, 0, s, 0, c), (0, 1, 0, s, c), (0, 0, 0, 0, 0)])
    at = None
    while True:
        found = [(m["aicc"], o) for o, m in seen.items() if m]
        if not found:
            raise ValueError("no order fits")
        best = min(found)[1]
        if best == at:
            return seen[at]
        at = best
        moves = [(i, j, 0, 0) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j] + [(0, 0, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
        tried([(*(a + b for a, b in zip(at, step)), at[4]) for step in moves] + [(*at[:4], 1 - at[4])])


def _searched(y: np.ndarray, h: int, spec: Spec, specs: list[Spec], max_p: int, max_q: int) -> tuple[dict, np.ndarray, np.ndarray] | None:
    """The best model of one spec with its forecast; None where the series is too short for it."""
    skip, held = arima_skip(len(y), specs, max_p)
    if spec not in held:
        return None
    scale = float(y.std()) if y.std() > 1e-9 * np.abs(y).max(initial=0) else 1.0
    try:
        m = arima_search(y / scale, spec, skip, max_p, max_q)
    except ValueError:
        return None
    mean, sd = sarima_path(y / scale, m, h)
    return m, mean * scale, sd * scale


def auto_arima(max_p: int = 5, max_q: int = 5, max_d: int = 2, seasons: tuple[int, ...] = (4, 7, 24)) -> Model:
    """The least corrected AIC over the searches of every season, difference and seasonal difference; auto_arima_rows() deals them out."""
    specs = arima_specs(max_d, seasons)

    def fit(y: np.ndarray, h: int):
        y = y.astype(float)
        found = [r for s in specs if (r := _searched(y, h, s, specs, max_p, max_q))]
        if not found:
            raise ValueError("no order fits")
        return min(found, key=lambda r: r[0]["aicc"])[1:]

    return fit


def auto_arima_rows(panel: DataFrame, h: int, fallback: Model, max_p: int = 5, max_q: int = 5, max_d: int = 2, seasons: tuple[int, ...] = (4, 7, 24), z: float = Z90) -> DataFrame:
    """As forecast() with auto_arima(): each search is a row of its own, fitted by itself, and the best of a series is kept."""
    specs = arima_specs(max_d, seasons)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("ts")["y"].to_numpy(float)
        found = _searched(y, h, specs[key[1]], specs, max_p, max_q)
        if found is not None and np.isfinite(found[1]).all():
            m, mean, sd = found
            return pd.DataFrame({"series_id": [key[0]], "rank": [m["aicc"]], "spec": [key[1]], "yhat": [mean], "sd": [sd], "status": ["ok"]})
        if key[1]:
            return pd.DataFrame(columns=["series_id", "rank", "spec", "yhat", "sd", "status"])
        mean, sd = fallback(y, h)  # of the first spec only: ranks behind every fit
        return pd.DataFrame({"series_id": [key[0]], "rank": [np.inf], "spec": [key[1]], "yhat": [mean], "sd": [sd], "status": ["ValueError: no order fits"]})

    dealt = panel.where("y IS NOT NULL").select(KEY, "ts", "y", F.explode(F.sequence(F.lit(0), F.lit(len(specs) - 1))).alias("spec"))
    each = dealt.repartition(len(specs), KEY, "spec").groupBy(KEY, "spec").applyInPandas(fit, "series_id string, rank double, spec int, yhat array<double>, sd array<double>, status string")
    best = each.groupBy(KEY).agg(F.min_by(F.struct("yhat", "sd", "status"), F.struct("rank", "spec")).alias("b"))
    step = best.select(KEY, "b.status", F.posexplode(F.arrays_zip("b.yhat", "b.sd")).alias("i", "v"))
    band = lambda s: F.col("v.yhat") + s * z * F.col("v.sd")
    return step.select(KEY, F.lit("auto_arima").alias("model"), (F.col("i") + 1).cast("long").alias("h"), F.col("v.yhat").alias("yhat"), band(-1).alias("lo"), band(1).alias("hi"), "status")


def sarima(p: int = 1, q: int = 1, season: int = 24) -> Model:
    """ARMA on seasonal differences, added up again season by season."""

    def fit(y: np.ndarray, h: int):
        z = y[season:] - y[:-season]
        m = arima_fit(z, p, 0, q)
        step = arima_path(z, m, h)
        out = list(y)
        for v in step:
            out.append(v + out[-season])
        return np.array(out[len(y) :]), m["sigma"] * np.sqrt(np.cumsum(_psi(m, h) ** 2))

    return fit


def smooth(y: np.ndarray, a: float, b: float, g: float, season: int, damp: float = 1.0) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Additive Holt-Winters: one-step errors, level, slope and seasonal terms; season 1 is Holt's method."""
    s = np.zeros(season) if season == 1 else y[:season] - y[:season].mean()
    level, slope = (y[0], 0.0) if season == 1 else (y[:season].mean(), (y[season : 2 * season].mean() - y[:season].mean()) / season)
    s, e = s.copy(), np.zeros(len(y))
    for t, v in enumerate(y):
        i = t % season
        e[t] = v - (level + damp * slope + s[i])
        last = level
        level = a * (v - s[i]) + (1 - a) * (level + damp * slope)
        slope = b * (level - last) + (1 - b) * damp * slope
        if season > 1:
            s[i] = g * (v - level) + (1 - g) * s[i]
    return e, level, slope, s


def holt_winters(season: int = 24, damped: bool = False, fixed: tuple[float, float, float] | None = None) -> Model:
    """Parameters by least squares of one-step errors unless fixed."""

    def fit(y: np.ndarray, h: int):
        def unpack(w):
            return 1 / (1 + np.exp(-w))

        def loss(w):
            p = unpack(w)
            e = smooth(y, p[0], p[1], p[2], season, p[3] if damped else 1.0)[0][season:]
            return float(e @ e)

        if fixed:
            a, b, g, damp = *fixed, 1.0
        else:
            a, b, g, damp = unpack(minimise(loss, np.array([-1.0, -3.0, -2.0, 3.0]), 80, 1.0))
            damp = damp if damped else 1.0
        e, level, slope, s = smooth(y, a, b, g, season, damp)
        steps = np.cumsum(damp ** np.arange(1, h + 1))
        mean = level + slope * steps + s[(len(y) + np.arange(h)) % season]
        return mean, e[season:].std() * np.sqrt(1 + np.arange(h) * a * a)

    return fit


def theta(season: int = 24) -> Model:
    """Theta 2: half the linear trend and half simple smoothing (weight by grid) of the seasonally adjusted values."""

    def fit(y: np.ndarray, h: int):
        n, t = len(y), np.arange(len(y))
        slots = np.array([y[t % season == k].mean() for k in range(season)]) - y.mean()
        x = y - slots[t % season]
        b, _ = ols(np.column_stack([np.ones(n), t]), x)
        line = 2 * x - (b[0] + b[1] * t)
        best = min((float(np.square(smooth(line, a, 0.0, 0.0, 1)[0][1:]).sum()), a) for a in np.linspace(0.05, 0.95, 19))[1]
        e, level, _, _ = smooth(line, best, 0.0, 0.0, 1)
        ahead = n + np.arange(h)
        return (level + b[0] + b[1] * ahead) / 2 + slots[ahead % season], (e[1:].std() / 2) * np.sqrt(1 + np.arange(h) * best**2)

    return fit


def fft_extrapolate(keep: int = 10) -> Model:
    """A linear trend and the strongest frequencies, carried on."""

    def fit(y: np.ndarray, h: int):
        n, t = len(y), np.arange(len(y))
        b = np.polyfit(t, y, 1)
        f = np.fft.rfft(y - np.polyval(b, t))
        top = np.argsort(-np.abs(f), kind="stable")[:keep]
        def at(x):
            return sum(np.real(f[k] * np.exp(2j * np.pi * k * x / n)) * (1 if k in (0, n / 2) else 2) for k in top) / n + np.polyval(b, x)
        return at(n + np.arange(h)), np.full(h, (y - at(t)).std())

    return fit


def mlp(lag: int = 24, hidden: tuple[int, int] = (64, 32), epochs: int = 60, seed: int = 42) -> Model:
    """A small network on the last values (relu, Adam), scaled by the training values; forecasts recursively."""

    def fit(y: np.ndarray, h: int):
        mu, sd = y.mean(), y.std() + 1e-9
        z = (y - mu) / sd
        x = np.lib.stride_tricks.sliding_window_view(z, lag)[:-1]
        want = z[lag:]
        rng = np.random.default_rng(seed)
        sizes = [lag, *hidden, 1]
        w = [rng.standard_normal((a, b)) * np.sqrt(2 / a) for a, b in zip(sizes, sizes[1:])]
        w += [np.zeros(b) for b in sizes[1:]]
        m, v, t, k = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0, len(sizes) - 1

        def forward(a):
            acts = [a]
            for i in range(k):
                a = acts[-1] @ w[i] + w[k + i]
                acts.append(np.maximum(a, 0) if i < k - 1 else a)
            return acts

        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), 64):
                b = order[at : at + 64]
                acts = forward(x[b])
                g = 2 * (acts[-1] - want[b, None]) / len(b)
                grads = [None] * (2 * k)
                for i in reversed(range(k)):
                    grads[i], grads[k + i] = acts[i].T @ g, g.sum(axis=0)
                    g = (g @ w[i].T) * (acts[i] > 0)
                t += 1
                for i, d in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        e = want - forward(x)[-1][:, 0]
        past = list(z[-lag:])
        for _ in range(h):
            past.append(float(forward(np.array(past[-lag:])[None])[-1][0, 0]))
        return np.array(past[lag:]) * sd + mu, np.full(h, e.std() * sd)

    return fit


def naive(season: int = 1) -> Model:
    def fit(y: np.ndarray, h: int):
        e = y[season:] - y[:-season]
        return y[-season:][np.arange(h) % season], e.std() * np.sqrt(1 + np.arange(h) // season)

    return fit


def average(last: int | None = None) -> Model:
    """The mean of all values, or of the last so many."""

    def fit(y: np.ndarray, h: int):
        if last and len(y) < last:
            raise ValueError("too short")
        held = y[-last:] if last else y
        return np.full(h, held.mean()), np.full(h, held.std())

    return fit


#: Models by name; a user adds their own.
MODELS: dict[str, Callable[[], Model]] = {
    "naive": naive, "seasonal_naive": lambda: naive(24), "average": average, "sparse_ar": sparse_ar, "arima_111": arima, "arima_212": lambda: arima(2, 1, 2), "auto_arima": auto_arima,
    "sarima": sarima, "ets": holt_winters, "damped_trend": lambda: holt_winters(24, True), "theta": theta, "fft": fft_extrapolate, "mlp": mlp,
}


def forecast(panel: DataFrame, models: dict[str, Model], h: int, fallback: Model | None = None, z: float = Z90) -> DataFrame:
    """Fits every model to every series and forecasts h steps: FORECAST rows; lo and hi are a normal band.

    Series and models are dealt out together, so that a task holds one series and
    fits one model. A model that fails on a series is replaced by the fallback
    (status says so) or left out with its reason as status and NULL forecasts.
    """
    names = F.explode(F.array(*map(F.lit, models)))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("ts")["y"].to_numpy(float)
        status = "ok"
        try:
            mean, sd = models[key[1]](y, h)
            if not np.isfinite(mean).all():
                raise ValueError("not finite")
        except Exception as e:  # noqa: BLE001  any model may fail on odd series
            status = f"{type(e).__name__}: {e}"[:80]
            mean, sd = fallback(y, h) if fallback and len(y) else (np.full(h, np.nan), np.full(h, np.nan))
        out = pd.DataFrame({"series_id": key[0], "model": key[1], "h": np.arange(1, h + 1), "yhat": mean, "lo": mean - z * sd, "hi": mean + z * sd, "status": status})
        return out.astype({"yhat": object, "lo": object, "hi": object}).where(out.notna(), None)

    dealt = panel.where("y IS NOT NULL").select("series_id", "ts", "y", names.alias("model"))
    return dealt.groupBy("series_id", "model").applyInPandas(fit, FORECAST)


def backtest(panel: DataFrame, models: dict[str, Model], h: int, step: int, windows: int, window: int | None = None) -> DataFrame:
    """Forecasts from several cutoffs: (series_id, model, cutoff, h, y, yhat).

    Cutoff 0 is the latest; each is step rows before the one after it. Every cutoff is a series of
    its own, so that fits run side by side; a window fits each on the last so many
    rows before it instead of on all of them.
    """
    from pyspark.sql import Window as W

    r = F.row_number().over(W.partitionBy(KEY).orderBy(F.col("ts").desc())) - 1
    back = panel.where("y IS NOT NULL").withColumn("r_", r)
    cut = F.explode(F.sequence(F.lit(0), F.lit(windows - 1)))
    each = back.select("*", cut.alias("cutoff")).withColumn("from_", F.col("cutoff") * step)
    before = F.col("r_") - F.col("from_") - h
    train = each.where((before >= 0) & (before < window) if window else before >= 0).select(F.concat_ws("|", KEY, "cutoff").alias(KEY), "ts", "y")
    fc = forecast(train, models, h).withColumns({"cutoff": F.element_at(F.split(KEY, r"\|"), -1).cast("int"), KEY: F.regexp_replace(KEY, r"\|\d+$", "")})
    test = each.where((F.col("r_") >= F.col("from_")) & (F.col("r_") < F.col("from_") + h)).select(KEY, "cutoff", "ts", "y", (F.col("from_") + h - F.col("r_")).cast("long").alias("h"))
    return test.join(fc, [KEY, "cutoff", "h"]).select(KEY, "model", F.col("cutoff").cast("long").alias("cutoff"), "ts", "h", "y", "yhat")


def historical_forecasts(panel: DataFrame, lags: tuple[int, ...] = (1,), start: float = 0.8, h: int = 12, stride: int = 1) -> DataFrame:
    """Forecasts of an autoregression fitted once: (series_id, ts, h, y, yhat) from every stride-th origin on.

    The first floor(n * start) values of a series fit the coefficients; the first
    origin is the last of them, and the last one leaves h values to compare with.
    Series too short for that give no rows.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        y, m, top = pdf["y"].to_numpy(float), int(len(pdf) * start), max(lags)
        if m < top + len(lags) + 1 or m - 1 + h >= len(y):
            return pd.DataFrame(columns=["series_id", "ts", "h", "y", "yhat"])
        b, _ = ols(*design(y[:m], list(lags)))
        origins = np.arange(m - 1, len(y) - h, stride)
        past = y[origins[:, None] - np.arange(top)[::-1]]
        for _ in range(h):
            past = np.column_stack([past, b[0] + past[:, [-k for k in lags]] @ b[1:]])
        at = origins[:, None] + np.arange(1, h + 1)
        steps = np.broadcast_to(np.arange(1, h + 1), at.shape)
        return pd.DataFrame({"series_id": key[0], "ts": pdf["ts"].to_numpy()[at.ravel()], "h": steps.ravel(), "y": y[at.ravel()], "yhat": past[:, top:].ravel()})

    have = panel.where("y IS NOT NULL").select("series_id", "ts", "y")
    return have.groupBy("series_id").applyInPandas(run, f"series_id string, ts {dict(have.dtypes)['ts']}, h long, y double, yhat double")


def recursive_forecast(model, panel: DataFrame, lags: tuple[int, ...], h: int, step: str = "1 hour", features: str = "features") -> DataFrame:
    """A fitted Spark model on ``feature_names(lags)`` carried on from its own forecasts: (series_id, h, yhat).

    One row a series holds its last values; each step appends a forecast to them, so
    no lag within the horizon is a true value.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import Window as W

    top = max(lags)
    r = F.row_number().over(W.partitionBy(KEY).orderBy(F.col("ts").desc()))
    last = panel.where("y IS NOT NULL").withColumn("r_", r).where(F.col("r_") <= top)
    state = last.groupBy(KEY).agg(F.max("ts").alias("ts"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "y"))), lambda s: s["y"]).alias("past")).where(F.size("past") == top)
    row = VectorAssembler(inputCols=feature_names(lags), outputCol=features)
    for _ in range(h):
        state = state.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {step}"))
        state = calendar_lags(state, {k: F.element_at("past", -k) for k in lags})
        state = model.transform(row.transform(state)).withColumn("past", F.concat("past", F.array("prediction"))).select(KEY, "ts", "past")
    return state.select(KEY, F.posexplode(F.slice("past", top + 1, h)).alias("h", "yhat")).select(KEY, (F.col("h") + 1).cast("long").alias("h"), "yhat")


def feature_names(lags: tuple[int, ...]) -> list[str]:
    return [*(f"lag_{k}" for k in lags), "hour", "dow"]


def calendar_lags(df: DataFrame, values: dict) -> DataFrame:
    """Adds the columns of feature_names() from each lag's column and the time."""
    return df.withColumns({f"lag_{k}": c for k, c in values.items()} | {"hour": F.hour("ts"), "dow": F.weekday("ts")})

"""Filters and smoothing of long series: a recurrence that is affine in its state runs over segments, whose maps are composed."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.segments import ROWS, scan
from chronoweave.session import intermediate, materialise

KEY = "series_id"
#: run(values, number of the first one from 0, state) gives a row of outputs for each value, and the state after them.
Recurrence = Callable[[np.ndarray, int, np.ndarray], tuple[np.ndarray, np.ndarray]]


def run_affine(df: DataFrame, run: Recurrence, states: int, names: list[str], rows: int = ROWS) -> DataFrame:
    """(series_id, ts, t, y, names): the outputs of a recurrence whose state after some values is an affine function of the state before them.

    Values are numbered over segments and dealt out in stretches of ``rows``. Each stretch first works out its map of the state (from
    states + 1 runs), the few maps of a series are composed, and each stretch runs again from the state that it starts with. No task
    holds more than a stretch of a series, or one small map for each of its stretches. A run that begins at number 0 makes its own state. Rows
    without a value are left out; times that are equal within a series follow in no fixed order.
    """
    kind, ts = dict(df.dtypes)[KEY], dict(df.dtypes)["ts"]
    with intermediate(df.sparkSession) as keep:
        numbered = scan(df.where("y is not null").select(KEY, "ts", "y"), {"t": ("rows", F.lit(1))}, rows=rows)
        dealt = keep(materialise(numbered.withColumn("t", F.col("t") - 1).withColumn("part", F.floor(F.col("t") / rows)), "stretches"))

        def in_order(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
            pdf = pdf.sort_values("t")
            return pdf, pdf["y"].to_numpy(float), int(pdf["t"].iloc[0])

        def mapped(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            _, y, first = in_order(pdf)
            offset = run(y, first, np.zeros(states))[1]
            columns = [run(y, first, e)[1] - offset for e in np.eye(states)]
            return pd.DataFrame({KEY: [key[0]], "part": [key[1]], "m": [np.concatenate([*columns, offset]).tolist()]})

        def composed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, state, begin = pdf.sort_values("part"), np.zeros(states), []
            for m in pdf["m"]:
                m = np.asarray(m).reshape(states + 1, states)
                begin.append(state.tolist())
                state = state @ m[:states] + m[states]
            return pd.DataFrame({KEY: key[0], "part": pdf["part"].to_numpy(), "begin": begin})

        def replayed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, y, first = in_order(pdf)
            out = run(y, first, np.asarray(pdf["begin"].iloc[0]))[0]
            columns = {n: pd.Series(out[:, i], dtype=object).where(~np.isnan(out[:, i]), None).to_numpy() for i, n in enumerate(names)}
            return pd.DataFrame({KEY: key[0], "ts": pdf["ts"].to_numpy(), "t": pdf["t"].to_numpy(), "y": y} | columns)

        maps = materialise(dealt.groupBy(KEY, "part").applyInPandas(mapped, f"{KEY} {kind}, part long, m array<double>"), "maps")
        begin = materialise(maps.groupBy(KEY).applyInPandas(composed, f"{KEY} {kind}, part long, begin array<double>"), "begin")
        schema = f"{KEY} {kind}, ts {ts}, t long, y double, " + ", ".join(f"{n} double" for n in names)
        held = dealt.join(begin.withColumnRenamed(KEY, "k_").withColumnRenamed("part", "p_"), F.col(KEY).eqNullSafe(F.col("k_")) & (F.col("part") == F.col("p_")))
        return keep(held.groupBy(KEY, "part").applyInPandas(replayed, schema))


@lru_cache
def _gains(dt: float, q: float, r: float, most: int = 10_000) -> np.ndarray:
    """The constant-velocity filter's gains, which depend on the number of values alone, until they settle."""
    f, h, p, out = np.array([[1, dt], [0, 1]]), np.array([1.0, 0.0]), np.eye(2), []
    for _ in range(most):
        p = f @ p @ f.T + q * np.eye(2)
        k = p @ h / (h @ p @ h + r)
        p = p - np.outer(k, h @ p)
        if out and (k == out[-1]).all():
            break
        out.append(k)
    return np.array(out)


def kalman(dt: float = 0.1, q: float = 0.1, r: float = 1.0) -> Recurrence:
    """Position and velocity by a constant-velocity filter from x = 0, P = I on."""

    def run(y: np.ndarray, first: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gains = _gains(dt, q, r)
        (x, v), out, last = state if first else (0.0, 0.0), np.empty((len(y), 2)), len(gains) - 1
        for i, z in enumerate(y.tolist()):
            a, b = gains[min(first + i, last)]
            x = x + dt * v
            miss = z - x
            x, v = x + a * miss, v + b * miss
            out[i] = x, v
        return out, np.array([x, v])

    return run


def smoothing(alpha: float = 0.5, beta: float | None = None) -> Recurrence:
    """The forecast of each value one step before: simple smoothing, or Holt's with beta; none of the first value."""

    def run(y: np.ndarray, first: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level, slope = state
        out = np.empty((len(y), 1))
        for i, v in enumerate(y.tolist()):
            if first + i == 0:
                out[i], level, slope = np.nan, v, 0.0
                continue
            ahead = level + slope
            out[i] = ahead
            new = alpha * v + (1 - alpha) * ahead
            slope = beta * (new - level) + (1 - beta) * slope if beta else 0.0
            level = new
        return out, np.array([level, slope])

    return run

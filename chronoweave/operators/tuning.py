"""Tuning by successive halving: rows of (series, candidate, cutoff), of which each round keeps the best."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators import models
from chronoweave.session import intermediate, materialise

KEY = "series_id"
#: A candidate: a model's name and its parameters.
Candidate = tuple[str, dict]
#: Models that take parameters, by name.
TUNABLE: dict[str, Callable[..., models.Model]] = {
    "naive": models.naive, "average": models.average, "sparse_ar": models.sparse_ar, "arima": models.arima, "sarima": models.sarima, "holt_winters": models.holt_winters,
    "theta": models.theta, "fft": models.fft_extrapolate, "mlp": models.mlp,
}


def _errors(held: DataFrame, left: DataFrame, candidates: list[Candidate], h: int, step: int, cutoffs: int, tunable: dict) -> DataFrame:
    """(series_id, candidate, rmse) of the candidates that are left, over the latest cutoffs; one fit a series, candidate and cutoff, NULL if one fails."""
    kind = dict(held.dtypes)[KEY]

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r_", ascending=False)
        y, known = pdf["y"].to_numpy(float), pdf["r_"].to_numpy() - key[2] * step >= h
        name, given = candidates[key[1]]
        try:
            if not known.any():
                raise ValueError("no values before the cutoff")
            ahead = tunable[name](**given)(y[known], h)[0]
            error = float(((ahead - y[~known]) ** 2).mean())
        except Exception:  # noqa: BLE001  any model may fail on odd series
            error = float("nan")
        return pd.DataFrame({KEY: [key[0]], "candidate": [key[1]], "error": pd.Series([error if np.isfinite(error) else None], dtype=object)})

    cut = F.explode(F.sequence(F.lit(0), F.lit(cutoffs - 1))).alias("cutoff")
    dealt = held.select("*", cut).where(F.col("r_") >= F.col("cutoff") * step).join(left, KEY)
    each = dealt.groupBy(KEY, "candidate", "cutoff").applyInPandas(fit, f"{KEY} {kind}, candidate int, error double")
    whole = F.count("error") == cutoffs
    return each.groupBy(KEY, "candidate").agg(F.when(whole, F.sqrt(F.avg("error"))).alias("rmse"))


def successive_halving(panel: DataFrame, candidates: list[Candidate], h: int, step: int | None = None, eta: int = 2, tunable: dict | None = None) -> DataFrame:
    """(series_id, candidate, model, params, cutoffs, rmse): the best of the candidates for each series; params is JSON.

    The first round backtests all of them from the latest cutoff, each further one the best 1 / eta that are left from eta times as
    many, until one is left, so that most fits are spent on what does well. Fits are rows of their own, dealt out over
    series, candidates and cutoffs; every round is a written table. Of equal errors (to nine places) the earlier candidate
    is better, one that fails on a series comes last. ``step`` rows (h by default) lie between cutoffs.
    """
    step, tunable = step or h, tunable or TUNABLE
    with intermediate(panel.sparkSession) as keep:
        back = F.row_number().over(W.partitionBy(KEY).orderBy(F.col("ts").desc())) - 1
        held = materialise(panel.where("y is not null").select(KEY, "y", back.alias("r_")), "held")
        left = held.select(KEY).distinct().withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(len(candidates) - 1))))
        count, cutoffs = len(candidates), 1
        while True:
            scored = materialise(_errors(held, left, candidates, h, step, cutoffs, tunable), "scored")
            count = -(-count // eta)
            order = F.row_number().over(W.partitionBy(KEY).orderBy(F.round("rmse", 9).asc_nulls_last(), "candidate"))
            best = scored.withColumn("place", order).where(F.col("place") <= count).drop("place")
            if count == 1:
                break
            left, cutoffs = best.select(KEY, "candidate"), cutoffs * eta
        named = F.array(*(F.struct(F.lit(n).alias("model"), F.lit(json.dumps(p, sort_keys=True)).alias("params")) for n, p in candidates))
        best = best.withColumn("spec", F.get(named, F.col("candidate")))
        return keep(best.select(KEY, F.col("candidate").cast("long").alias("candidate"), "spec.*", F.lit(cutoffs).cast("long").alias("cutoffs"), "rmse"))


def forecast_tuned(panel: DataFrame, winners: DataFrame, h: int, tunable: dict | None = None) -> DataFrame:
    """(series_id, model, h, yhat): each series by its own winner; winners is what successive_halving() gives, as it is or read back from a file."""
    tunable, kind = tunable or TUNABLE, dict(panel.dtypes)[KEY]

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("ts")["y"].to_numpy(float)
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(key[2]).items()}
        return pd.DataFrame({KEY: key[0], "model": key[1], "h": np.arange(1, h + 1), "yhat": tunable[key[1]](**given)(y, h)[0]})

    rows = panel.where("y is not null").select(KEY, "ts", "y").join(winners.where("rmse is not null").select(KEY, "model", "params"), KEY)
    return rows.groupBy(KEY, "model", "params").applyInPandas(fit, f"{KEY} {kind}, model string, h long, yhat double")

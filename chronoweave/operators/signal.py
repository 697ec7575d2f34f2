"""Spectra, filters, latent factors and small geometric summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.segments import scan
from chronoweave.operators.windows import numbered
from chronoweave.session import intermediate, materialise

KEY = "series_id"


def dft(df: DataFrame, n: int) -> DataFrame:
    """The discrete Fourier transform of every n values in a row, in built-ins: (series_id, block, k, re, im, magnitude, phase); the last block is filled up with zeros."""
    d = numbered(df).withColumns({"block": F.floor(F.col("i") / n), "k": F.explode(F.sequence(F.lit(0), F.lit(n // 2)))})
    angle = -2 * np.pi * F.col("k") * (F.col("i") % n) / n
    out = d.groupBy(KEY, "block", F.col("k").cast("long").alias("k")).agg(F.sum(F.col("y") * F.cos(angle)).alias("re"), F.sum(F.col("y") * F.sin(angle)).alias("im"))
    return out.withColumns({"magnitude": F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), "phase": F.atan2("im", "re")})


def spectrum(y: np.ndarray, rate: float = 1.0) -> pd.DataFrame:
    f = np.fft.rfft(y)
    return pd.DataFrame({"frequency": np.fft.rfftfreq(len(y), 1 / rate), "re": f.real, "im": f.imag, "magnitude": np.abs(f), "phase": np.angle(f)})


def strongest(y: np.ndarray, keep: int) -> np.ndarray:
    """The series from its strongest frequencies, each with its conjugate."""
    f = np.fft.rfft(y)
    f[np.argsort(-np.abs(f), kind="stable")[keep:]] = 0
    return np.fft.irfft(f, len(y))


def low_pass(y: np.ndarray, most: float = 0.1) -> np.ndarray:
    f = np.fft.rfft(y)
    f[np.fft.rfftfreq(len(y)) > most] = 0
    return np.fft.irfft(f, len(y))


def stft_db(df: DataFrame, size: int = 256, hop: int = 64) -> DataFrame:
    """(series_id, frame, bin, db): Hann-windowed frames' spectra in decibels below the series' loudest bin, -80 at least.

    A value goes to the size / hop frames that it is in, and each frame is transformed by itself, so that a series of any length is
    spread over tasks. A series shorter than a frame is one frame.
    """
    length = df.groupBy(F.col(KEY).alias("g_")).agg(F.count("y").alias("n_"))
    rows = scan(df.where("y is not null").select(KEY, "ts", "y"), {"i_": ("rows", F.lit(1))}).withColumn("i_", F.col("i_") - 1)
    rows = rows.join(length, F.col(KEY).eqNullSafe(F.col("g_"))).withColumn("size_", F.least(F.lit(size), F.col("n_")))
    first = F.greatest(F.lit(0), F.ceil((F.col("i_") - F.col("size_") + 1) / hop))
    last = F.least(F.floor(F.col("i_") / hop), F.floor((F.col("n_") - F.col("size_")) / hop))
    each = rows.where(first <= last).select(KEY, "y", "i_", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("frame"))

    def transform(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("i_")["y"].to_numpy(float)
        mag = np.abs(np.fft.rfft(y * np.hanning(len(y))))
        return pd.DataFrame({KEY: key[0], "frame": key[1], "bin": np.arange(len(mag)), "mag": mag})

    spectra = each.groupBy(KEY, "frame").applyInPandas(transform, f"{KEY} {dict(df.dtypes)[KEY]}, frame long, bin long, mag double")
    loudest = spectra.groupBy(F.col(KEY).alias("g_")).agg(F.max("mag").alias("top_"))
    db = 20 * F.log10(F.greatest(F.col("mag"), F.lit(1e-10)) / F.greatest(F.col("top_"), F.lit(1e-10)))
    return spectra.join(loudest, F.col(KEY).eqNullSafe(F.col("g_"))).select(KEY, "frame", "bin", F.greatest(db, F.lit(-80.0)).alias("db"))


def _summed(rows: DataFrame, vectors: DataFrame, on: str, to: str, width: int) -> DataFrame:
    """Of each ``to`` the sum of y times the vector of its rows' ``on``."""
    return rows.join(vectors, on).groupBy(to).agg(*(F.sum(F.col("y") * F.col(f"v{k}")).alias(f"v{k}") for k in range(width)))


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """The sums of all products of two of the vectors' few components."""
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = vectors.agg(*(F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"g{i}_{j}") for i, j in pairs)).first()
    g = np.zeros((width, width))
    for i, j in pairs:
        g[i, j] = g[j, i] = sums[f"g{i}_{j}"] or 0.0
    return g


def _turned(vectors: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """The vectors times a small matrix."""
    return vectors.select(key, *(sum((F.col(f"v{i}") * float(m[i, k]) for i in range(len(m))), F.lit(0.0)).alias(f"v{k}") for k in range(m.shape[1])))


def latent_factors(df: DataFrame, rank: int = 3, spare: int = 10, rounds: int = 6, seed: int = 1) -> DataFrame:
    """(ts, error): mean squared error over series of a truncated SVD of the series-by-time matrix, missing values being 0.

    A randomised projection: rank + spare hashed normal directions of the series are multiplied by the matrix and its transpose
    in turn, each time one join and one sum a series or a time, and made orthogonal by their Gram matrix of
    rank + spare squared numbers, which is all that the driver sees. Neither the number of series nor that of times matters to it.
    With no more series than directions the result is exact, else it closes in on the factors by every round.
    """
    with intermediate(df.sparkSession) as keep:
        rows = keep(materialise(df.where("y is not null").select(KEY, "ts", F.col("y").cast("double").alias("y")), "matrix"))
        names = df.select(KEY).where(F.col(KEY).isNotNull()).distinct()
        width, count = rank + spare, names.count()
        unit = lambda k, i: (F.pmod(F.xxhash64(KEY, F.lit(k), F.lit(i), F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
        basis = names.select(KEY, *((F.sqrt(-2 * F.log(unit(k, 0))) * F.cos(2 * np.pi * unit(k, 1))).alias(f"v{k}") for k in range(width)))
        for turn in range(rounds + 1):
            basis = materialise(basis, "basis")
            values, vectors = np.linalg.eigh(_gram(basis, width))
            some = values > max(values.max(initial=0.0), 0.0) * 1e-13
            basis, width = _turned(basis, KEY, vectors[:, some] / np.sqrt(values[some])), int(some.sum())
            if turn < rounds:
                basis = _summed(rows, materialise(_summed(rows, basis, KEY, "ts", width), "times"), "ts", KEY, width)
        inside = materialise(_summed(rows, materialise(basis, "basis"), KEY, "ts", width), "times")
        top = np.linalg.eigh(_gram(inside, width))[1][:, ::-1][:, :rank]
        caught = _turned(inside, "ts", top)
        caught = caught.select("ts", sum((F.col(c) * F.col(c) for c in caught.columns[1:]), F.lit(0.0)).alias("caught"))
        every = df.select("ts").distinct().join(rows.groupBy("ts").agg(F.sum(F.col("y") * F.col("y")).alias("all")), "ts", "left").join(caught, "ts", "left")
        error = F.greatest(F.coalesce("all", F.lit(0.0)) - F.coalesce("caught", F.lit(0.0)), F.lit(0.0)) / count
        return keep(every.select("ts", error.alias("error")))


def ellipse(df: DataFrame, x: str, y: str, by: str = KEY, points: int = 100) -> DataFrame:
    """Points of the one-deviation ellipse of two columns, from the closed form of a 2 x 2 matrix's eigenpairs."""
    s = df.groupBy(by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_samp(x) + 1e-6).alias("a"), F.covar_samp(x, y).alias("b"), (F.var_samp(y) + 1e-6).alias("c"))
    mid, gap = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.pow("b", 2))
    s = s.withColumns({"r1": F.sqrt(mid + gap), "r2": F.sqrt(F.greatest(mid - gap, F.lit(0.0))), "tilt": F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2})
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    t = 2 * np.pi * F.col("i") / (points - 1)
    px, py = F.col("r1") * F.cos(t), F.col("r2") * F.sin(t)
    return s.select(by, F.col("i").cast("long").alias("i"), (F.col("mx") + px * F.cos("tilt") - py * F.sin("tilt")).alias("x"), (F.col("my") + px * F.sin("tilt") + py * F.cos("tilt")).alias("y"))


def damped_wave(n: int, decay: float = 0.1, period: float = 10.0) -> list[float]:
    """The response to an impulse at the times 0 to n - 1."""
    t = np.arange(n)
    return (np.exp(-decay * t) * np.sin(2 * np.pi * t / period)).tolist()


def blend(pairs: DataFrame, source: str, target: str, steps: int = 50) -> DataFrame:
    """Mean squared distance to the target of source * (1 - a) + target * a for a from 0 to 1: one pass, one row a step."""
    a = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / (steps - 1)))
    d = pairs.withColumn("a", a)
    mixed = F.col(source) * (1 - F.col("a")) + F.col(target) * F.col("a")
    return d.groupBy("a").agg(F.avg(F.pow(mixed - F.col(target), 2)).alias("mse"))


def ribbon(df: DataFrame, predicted: str, width: str) -> DataFrame:
    return df.withColumns({"lo": F.col(predicted) - F.col(width), "hi": F.col(predicted) + F.col(width)})

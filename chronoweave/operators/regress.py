"""Least squares from sums of products: Spark adds them up in one aggregate, and a few numbers a group are solved where they are."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def products(df: DataFrame, by: str, cols: list[Column], where: Column | None = None, *more: Column) -> DataFrame:
    """(by, n, sums, more): the number of rows that meet ``where`` and the sums of all products of two columns over them.

    Sums are those of the upper triangle, row by row. Columns that are far from 0 had better be centred before.
    """
    keep = (lambda c: F.when(where, c)) if where is not None else (lambda c: c)
    sums = F.array(*(F.coalesce(F.sum(keep(a * b)), F.lit(0.0)) for i, a in enumerate(cols) for b in cols[i:]))
    return df.groupBy(by).agg(F.count(keep(F.lit(1))).alias("n"), sums.alias("sums"), *more)


def solved(sums: DataFrame, by: str, f: Callable[..., tuple], schema: str, *more: str) -> DataFrame:
    """f(n, matrix of products, more columns) of each group as a row (by, schema)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for n, s, *rest in zip(pdf["n"], pdf["sums"], *(pdf[c] for c in more)):
                k = int((2 * len(s)) ** 0.5)
                g = np.zeros((k, k))
                g[np.triu_indices(k)] = s
                rows.append(f(int(n), g + np.triu(g, 1).T, *rest))
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, by, pdf[by].to_numpy())
            yield out

    return sums.select(by, "n", "sums", *more).mapInPandas(run, f"{by} {dict(sums.dtypes)[by]}, {schema}")


def fitted(g: np.ndarray, x: list[int], y: int) -> tuple[np.ndarray, float]:
    """Coefficients of column y on columns x, and what they leave of its sum of squares."""
    b = np.linalg.lstsq(g[np.ix_(x, x)], g[x, y], rcond=None)[0]
    return b, max(float(g[y, y] - b @ g[x, y]), 0.0)

"""Wide and long frames, unions and aligned joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def spread(df: DataFrame, by: list[str], col: str, values: list[str], agg) -> DataFrame:
    """Long to wide; the values are given, so that no extra pass looks for them."""
    return df.groupBy(*by).pivot(col, values).agg(agg)


def union_by_name(frames: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """Rows of all frames with the name of the one they come from; missing columns are NULL."""
    named = [f.withColumn(source, F.lit(n)) for n, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def align(frames: dict[str, DataFrame], how: str = "full") -> DataFrame:
    """Series (ts, y) side by side on their times, one column for each."""
    renamed = [f.select("ts", F.col("y").alias(n)) for n, f in frames.items()]
    return reduce(lambda a, b: a.join(b, "ts", how), renamed)


def zip_forecast(actual: DataFrame, forecast: DataFrame, by: str = "series_id") -> DataFrame:
    """Pairs the h-th row after the cut with the h-th forecast."""
    h = F.row_number().over(W.partitionBy(by).orderBy("ts")).cast("long")
    return actual.withColumn("h", h).join(forecast, [by, "h"])


def nearest(queries: DataFrame, points: DataFrame, k: int, id_col: str, vector_col: str, query_block: int = 8192, point_block: int = 65_536) -> DataFrame:
    """The k nearest points (Euclidean, of equals the smaller id) of each query, itself left out: (query, neighbour, distance, rank).

    Queries and points are dealt out in blocks of about the given sizes and each
    block of queries meets each block of points in one task, which sends only k rows
    for each query. Ids are whole numbers; rows without an id or a vector are left out.
    """
    import numpy as np
    import pyarrow as pa

    def dealt(df: DataFrame, block: int) -> tuple[DataFrame, int]:
        have = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        n = max(1, -(-have.count() // block))
        place = F.pmod(F.xxhash64(id_col, vector_col, F.monotonically_increasing_id()), F.lit(n)).cast("int")
        return have.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), place.alias("at_")), n

    (q, nq), (x, nx) = dealt(queries, query_block), dealt(points, point_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("id", "v", F.col("at_").alias("qb"), every(nx).alias("pb"))
    x = x.select("id", "v", every(nq).alias("qb"), F.col("at_").alias("pb"))

    def arrays(t: pa.Table) -> tuple:
        t = t.combine_chunks()
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return t.column("id").to_numpy(), flat.reshape(t.num_rows, -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            (qid, a), (pid, b) = arrays(left), arrays(right)
            norms = (b * b).sum(axis=1)
            for s in range(0, len(qid), 128):
                part, ids = a[s : s + 128], qid[s : s + 128]
                d = np.sqrt(np.maximum((part * part).sum(axis=1)[:, None] + norms - 2 * part @ b.T, 0))
                d[ids[:, None] == pid] = np.inf
                most = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                row, at = np.nonzero((d <= most[:, None]) & np.isfinite(d))
                dist = d[row, at]
                order = np.lexsort((pid[at], dist, row))
                row, at, dist = row[order], at[order], dist[order]
                ok = np.arange(len(row)) - np.searchsorted(row, row) < k
                parts.append((ids[row[ok]], pid[at[ok]], dist[ok]))
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query": cols[0], "neighbour": cols[1], "distance": cols[2]})

    found = q.groupBy("qb", "pb").cogroup(x.groupBy("qb", "pb")).applyInArrow(meet, "query long, neighbour long, distance double")
    w = W.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)

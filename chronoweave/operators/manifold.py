"""Neighbours among the delay vectors of long series: vectors are rows in blocks, and blocks that are too far apart never meet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.windows import delay_embedding, numbered
from chronoweave.session import intermediate, materialise

KEY = "series_id"
#: Vectors that a block holds about.
BLOCK = 4096


def blocked(points: DataFrame, by: list[str], cols: list[str], block: int = BLOCK) -> DataFrame:
    """Adds block: cells of a grid over the first and the last coordinate, full ones dealt out by a hash of the vector's number i."""
    first, last = F.col(cols[0]), F.coalesce(*(F.col(c) for c in reversed(cols)))
    flat = F.count(cols[1]) == 0 if len(cols) > 1 else F.lit(True)  # one coordinate: both are the same
    side = F.ceil(F.when(flat, F.count("*") / block).otherwise(F.sqrt(F.count("*") / block))).alias("m_")
    ends = points.groupBy(by).agg(side, *(f(v).alias(n) for v, s in ((first, "a"), (last, "b")) for f, n in ((F.min, f"{s}_lo"), (F.max, f"{s}_hi"))))
    place = lambda v, s: F.least(F.floor(F.coalesce(F.try_divide(v - F.col(f"{s}_lo"), F.col(f"{s}_hi") - F.col(f"{s}_lo")), F.lit(0.0)) * F.col("m_")), F.col("m_") - 1)
    in_cells = points.join(ends, by).withColumn("cell_", (place(first, "a") * F.col("m_") + place(last, "b")).cast("long")).select(*points.columns, "cell_")
    full = in_cells.groupBy(*by, "cell_").agg(F.ceil(F.count("*") / block).alias("k_"))
    salt = F.pmod(F.xxhash64("i"), F.col("k_"))
    return in_cells.join(full, [*by, "cell_"]).withColumn("block", F.col("cell_") * (1 << 24) + salt).select(*points.columns, "block")


def boxes(points: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Number of vectors and bounds of each coordinate of each block."""
    return points.groupBy(*by, "block").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))))


def box_pairs(box: DataFrame, by: list[str]) -> DataFrame:
    """Every two boxes (a, b) of a group, bounds prefixed by a_ and b_; a row a pair of blocks, not of vectors."""
    side = lambda s: box.select(*by, *(F.col(c).alias(f"{s}_{c}") for c in box.columns if c not in by))
    return side("a").join(side("b"), by)


def _apart(c: str) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.col(f"b_{c}_lo") - F.col(f"a_{c}_hi"), F.col(f"a_{c}_lo") - F.col(f"b_{c}_hi")), F.lit(0.0))


def _across(c: str) -> Column:
    return F.coalesce(F.greatest(F.col(f"b_{c}_hi") - F.col(f"a_{c}_lo"), F.col(f"a_{c}_hi") - F.col(f"b_{c}_lo")), F.lit(0.0))


def least_distance(cols: list[str]) -> Column:
    """No vector of box a is nearer to one of box b."""
    return F.sqrt(reduce(lambda x, y: x + y, (_apart(c) * _apart(c) for c in cols)))


def most_distance(cols: list[str]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, (_across(c) * _across(c) for c in cols)))


def meet(points: DataFrame, pairs: DataFrame, by: list[str], f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of the two tables of vectors of every pair of blocks (a_block, b_block); each pair is a task's group of two blocks."""
    of = [*by, "a_block", "b_block"]
    side = lambda c: points.join(pairs.select(*of, F.col(c).alias("block")), [*by, "block"])
    both = side("a_block").withColumn("left_", F.lit(True)).unionByName(side("b_block").withColumn("left_", F.lit(False)))

    def run(t: pa.Table) -> pa.Table:
        left = t["left_"].to_numpy()
        return f(t.filter(pa.array(left)), t.filter(pa.array(~left)))

    return both.groupBy(of).applyInArrow(run, schema)


def _matrix(t: pa.Table, cols: list[str]) -> np.ndarray:
    columns = [t[c].to_numpy() for c in cols]
    return np.column_stack([c for c in columns if not np.isnan(c.astype(float)).all()] or columns[:1]).astype(float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        total += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(total)


def _kept(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Intermediate tables that the result doesn't read are removed when it is made."""

    @wraps(f)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        with intermediate(df.sparkSession) as keep:
            return keep(f(df, *args, **kwargs))

    return run


@_kept
def neighbours(points: DataFrame, cols: list[str], k: int, by: str = KEY, block: int = BLOCK) -> DataFrame:
    """(by, i, j, distance, rank): the k nearest other vectors of the same series, of equals the smaller number.

    points: (by, i, the coordinates). A block's own box, or another one with at least k vectors, bounds how far
    the k-th neighbour of any of its vectors can be; only blocks whose boxes are no farther than the least
    such bound meet, each pair sends k rows a vector, and the k best of these stay. Rows with a null coordinate are left out.
    """
    points = materialise(blocked(points.select(by, "i", *cols).dropna(), [by], cols, block), "vectors")
    pairs = box_pairs(boxes(points, [by], cols), [by]).withColumns({"low_": least_distance(cols), "high_": most_distance(cols)})
    enough = F.col("b_n") - (F.col("a_block") == F.col("b_block")).cast("int") >= k
    bound = F.min(F.when(enough, F.col("high_"))).over(W.partitionBy(by, "a_block"))
    pairs = materialise(pairs.withColumn("bound_", bound).where("bound_ is null or low_ <= bound_ * (1 + 1e-12)").select(by, "a_block", "b_block"), "pairs")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            a, b, i, j = _matrix(left, cols), _matrix(right, cols), left["i"].to_numpy(), right["i"].to_numpy()
            order = np.argsort(j)
            b, j = b[order], j[order]
            for s in range(0, len(a), 512):
                d = _distances(a[s : s + 512], b)
                d[i[s : s + 512, None] == j] = np.inf
                most = min(k, d.shape[1])
                near = np.partition(d, most - 1, axis=1)[:, most - 1]
                row, at = np.nonzero((d <= near[:, None]) & np.isfinite(d))
                dist = d[row, at]
                order = np.lexsort((j[at], dist, row))
                row, at, dist = row[order], at[order], dist[order]
                ok = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append((i[s : s + 512][row[ok]], j[at[ok]], dist[ok]))
        cols_ = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        name = left[by][0] if left.num_rows else None
        return pa.table({by: pa.array([name.as_py()] * len(cols_[0]) if name is not None else [], left.schema.field(by).type), "i": cols_[0], "j": cols_[1], "distance": cols_[2]})

    kind = dict(points.dtypes)[by]
    found = meet(points, pairs, [by], best, f"{by} {kind}, i long, j long, distance double")
    rank = F.row_number().over(W.partitionBy(by, "i").orderBy("distance", "j"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def cross_maps(panel: DataFrame, dims: int = 3, delay: int = 10, block: int = BLOCK) -> DataFrame:
    """(source, target, r): how well each series is told from each other's manifold, for all ordered pairs of series.

    panel: (series_id, ts, y), the same times for all series. The neighbours of a target's delay vectors serve every source: its values
    there, weighted by 1 / (distance + 1e-9) over dims + 1 neighbours, estimate its value, and r is the correlation of the two.
    """
    values = numbered(panel.where("y is not null")).select(KEY, "i", "y")
    cols = [f"e{d}" for d in range(dims)]
    vectors = delay_embedding(numbered(panel.where("y is not null")), dims, delay).select(KEY, "i", *cols)
    near = neighbours(vectors, cols, dims + 1, block=block).withColumn("w", 1 / (F.col("distance") + 1e-9))
    other = values.select(F.col(KEY).alias("source"), F.col("i").alias("j"), F.col("y").alias("v"))
    met = near.select(F.col(KEY).alias("target"), "i", "j", "w").join(other, "j").where("source <> target")
    guess = met.groupBy("source", "target", "i").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("guess"))
    return guess.join(values.withColumnRenamed(KEY, "source"), ["source", "i"]).groupBy("source", "target").agg(F.corr("y", "guess").alias("r"))


@_kept
def false_neighbour_ratios(panel: DataFrame, most: int = 5, ratio: float = 10.0, block: int = BLOCK) -> DataFrame:
    """(series_id, dims, ratio) for 1 to ``most`` dimensions: ordered pairs of delay vectors whose distance one step on is more than ratio times theirs, over the number of vectors.

    Blocks of which no two vectors can be that much farther apart one step on (by the boxes of both) never meet.
    """
    cols, ahead = [f"e{d}" for d in range(most)], [f"f{d}" for d in range(most)]
    w, steps = W.partitionBy(KEY).orderBy("i"), [f"e{d}" for d in range(most + 1)]
    rows = numbered(panel.where("y is not null")).withColumns({c: F.lead("y", d).over(w) for d, c in enumerate(steps)})
    k = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("dims")
    each = rows.select(KEY, "i", k, *steps)
    now = {f"e{d}": F.when(F.col("dims") > d, F.col(f"e{d}")) for d in range(most)}
    then = {f"f{d}": F.when(F.col("dims") > d, F.col(f"e{d + 1}")) for d in range(most)}
    last = F.element_at(F.array(*steps[1:]), F.col("dims"))
    each = each.where(last.isNotNull()).select(KEY, "i", F.col("dims").cast("long").alias("dims"), *(v.alias(n) for n, v in (now | then).items()))
    by = [KEY, "dims"]
    points = materialise(blocked(each, by, cols, block), "vectors")
    pairs = box_pairs(boxes(points, by, [*cols, *ahead]), by).where(most_distance(ahead) * (1 + 1e-12) > ratio * (least_distance(cols) * (1 - 1e-12)))
    pairs = materialise(pairs.select(*by, "a_block", "b_block"), "pairs")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        n = 0
        if left.num_rows and right.num_rows:
            sides = [(_matrix(t, cols), _matrix(t, ahead)) for t in (left, right)]
            for s in range(0, left.num_rows, 512):
                d = _distances(sides[0][0][s : s + 512], sides[1][0]) + 1e-10
                n += int((_distances(sides[0][1][s : s + 512], sides[1][1]) / d > ratio).sum())
        some = left if left.num_rows else right
        return pa.table({KEY: some[KEY][:1], "dims": some["dims"][:1], "hits": pa.array([n], pa.int64())})

    hits = meet(points, pairs, by, count, f"{KEY} {dict(points.dtypes)[KEY]}, dims long, hits long").groupBy(by).agg(F.sum("hits").alias("hits"))
    total = points.groupBy(by).agg(F.count("*").alias("n"))
    return total.join(hits, by, "left").select(KEY, "dims", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("ratio"))

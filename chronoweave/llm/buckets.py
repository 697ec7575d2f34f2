"""Components of similar items from buckets of candidates, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.components import connected
from chronoweave.session import materialise

#: Buckets of at most so many ids are compared pair by pair.
SMALL = 8
#: Ids of one side of a tile of a larger bucket.
SIDE = 256


class Test(Protocol):
    """Compares the rows of a tile; made of the tile's payload."""

    def likely(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of one row of a and one of b that may be linked, the likeliest first."""

    def same(self, i: int, j: int) -> bool:
        """Whether two rows are linked."""


def _meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting, so that neither side is broadcast.

    Spark takes rows that a task or explode() multiplied (an id for each of its tables or tiles) for no more than the
    rows they come from, and well compressed ones for as few bytes as their files have; the driver would hold them all.
    """
    return left.hint("merge").join(right, on, how)


def bucket_components(
    banded: DataFrame, links_of: Callable[[DataFrame], DataFrame], payload_of: Callable[[DataFrame], DataFrame], test: Callable[[pa.Table], Test], known: DataFrame | None = None
) -> DataFrame:
    """(id, component) of the ids that are linked; an id without links may be missing.

    banded: (id, key), ids that share a key are candidates. links_of(pairs (a, b))
    gives those that are linked as (u, v). Each bucket first compares all of its
    ids with its smallest one: a bucket of n copies costs n comparisons. Then, in
    buckets that hold several components, the ids outside the smallest one's
    component are compared with those of other components, so that each pair
    of a bucket that could join two components is decided. Small buckets do that
    pair by pair; larger ones in tiles of at most SIDE by SIDE ids, which hold
    payload_of(ids (id)), give only the links that join two components, and skip
    pairs whose components have met. Every round is a written table.
    """
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1")
    buckets = materialise(_meet(banded, shared, "key"), "buckets")
    asked = materialise(buckets.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "asked")
    links = links_of(asked)
    found = materialise(connected(links if known is None else links.union(known)), "components")
    label = buckets.where("n > 2").join(found.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    main = found.select(F.col("id").alias("pivot"), F.col("component").alias("main"))
    label = label.join(main, "pivot", "left").withColumn("apart", F.col("c") != F.coalesce("main", "pivot"))
    label = materialise(label.where("id <> pivot"), "labels")
    # n: ids but the smallest; outside: those of them in another component than its
    wide = label.groupBy("key").agg(F.count("*").alias("rest"), F.sum(F.col("apart").cast("long")).alias("outside"), F.min("c").alias("low"), F.max("c").alias("high"))
    open_ = materialise(_meet(label.drop("n"), wide.where("outside > 0 and low <> high"), "key"), "open")

    small = open_.where(F.col("rest") <= SMALL)
    left, right = small.where("apart").select("key", "id", "c"), small.select("key", F.col("id").alias("id2"), F.col("c").alias("c2"))
    pairs = _meet(left, right, "key").where("c <> c2").select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    more = links_of(materialise(_meet(pairs, asked, ["a", "b"], "left_anti"), "asked"))
    large = open_.where(F.col("rest") > SMALL)
    if not large.isEmpty():
        more = more.union(materialise(_tiled(large, payload_of, test), "tiles"))
    if more.isEmpty():
        return found
    stars = found.select(F.col("id").alias("u"), F.col("component").alias("v"))
    return materialise(connected(stars.union(more)), "components")


def _tiled(large: DataFrame, payload_of: Callable[[DataFrame], DataFrame], test: Callable[[pa.Table], Test]) -> DataFrame:
    """Links (u, v) that join two components of a bucket: its outside ids against all, tile by tile."""
    payload = payload_of(large.select("id").distinct())
    of = large.withColumns({"kx": F.ceil(F.col("outside") / SIDE).cast("int"), "ky": F.ceil(F.col("rest") / SIDE).cast("int"), "h": F.xxhash64("id")})
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    x = of.where("apart").select("key", "id", "c", F.pmod("h", "kx").cast("int").alias("i"), spread("ky").alias("j"), F.lit(True).alias("left"))
    y = of.select("key", "id", "c", spread("kx").alias("i"), F.pmod("h", "ky").cast("int").alias("j"), F.lit(False).alias("left"))
    rows = _meet(x.union(y), payload, "id")

    def tile(key, table):
        ids, comp, left = (table[c].to_numpy() for c in ("id", "c", "left"))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        out = []
        if left.any() and not left.all():
            check = test(table)
            for i, j in check.likely(np.flatnonzero(left), np.flatnonzero(~left)):
                a, b = root(int(comp[i])), root(int(comp[j]))
                if a != b and check.same(i, j):
                    parent[max(a, b)] = min(a, b)
                    out.append((int(ids[i]), int(ids[j])))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(tile, "u long, v long")

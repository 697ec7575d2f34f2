"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import materialise


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (u, v): the smallest id that can be reached.

    Alternates large-star and small-star steps, which end in stars around each
    component's smallest id after about log(n) rounds. A hub's links meet in joins
    that Spark can split and in minima that are taken before the shuffle; each
    round is a written table. An empty list gives an empty table.
    """
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

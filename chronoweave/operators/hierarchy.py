"""Hierarchies of any depth, from a table of children and parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import intermediate, materialise


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestor, level) for every ancestor of every node, level steps above it; a node with several parents keeps every level.

    Paths double: those of up to n steps are lengthened by those of exactly n, so that a hierarchy of depth d takes
    about log2(d) joins. Edges with a null end are left out and repeated ones count once.
    A cycle is an error that names a node in it, found once paths are as long as it is.
    """
    with intermediate(edges.sparkSession) as keep:
        e = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull())
        paths = materialise(e.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).cast("long").alias("level")).distinct(), "paths")
        reach = 1
        while True:
            round_trip = paths.where("node = ancestor").select("node").first()
            if round_trip:
                raise ValueError(f"the hierarchy has a cycle through {round_trip[0]!r}")
            upper = paths.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("level").alias("more"))
            longer = paths.where(F.col("level") == reach).join(upper, "ancestor").select("node", F.col("above").alias("ancestor"), (F.col("level") + F.col("more")).alias("level"))
            longer = materialise(longer.distinct(), "paths")
            if longer.isEmpty():
                return keep(paths)
            paths, reach = materialise(paths.union(longer), "paths"), 2 * reach


def leaves(paths: DataFrame) -> DataFrame:
    """The rows of a closure() whose node is no node's ancestor."""
    return paths.join(paths.select(F.col("ancestor").alias("node")).distinct(), "node", "left_anti")


def rolled_up(values: DataFrame, paths: DataFrame, node: str = "node", col: str = "y") -> DataFrame:
    """(node, y): the sum of a column over each node itself and all below it; of nodes that several ways lead to, once each."""
    own = values.groupBy(F.col(node).alias("node")).agg(F.sum(col).alias("y_"))
    above = own.join(paths.select("node", "ancestor").distinct(), "node").select(F.col("ancestor").alias("node"), "y_")
    return own.unionByName(above).groupBy("node").agg(F.sum("y_").alias(col))

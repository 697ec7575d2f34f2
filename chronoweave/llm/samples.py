"""Bounded samples of labelled rows, and the folds that contracts fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n."""
    return F.crc32(F.col(id_col).cast("string")) % n


def labelled_sample(labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """At most ``most`` rows (doc_id, y) of those to learn from, the same ones whatever the partitions."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).select("doc_id", F.col(label).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)

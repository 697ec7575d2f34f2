"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.minhash import near_duplicates
from chronoweave.llm.packing import pack_documents
from chronoweave.llm.quality import score_quality
from chronoweave.llm.suffix_dedup import cut_repeats
from chronoweave.llm.toxicity import score_toxicity
from chronoweave.session import intermediate, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _reject(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids; rows without a doc_id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't predict to be good go; of rows that share a doc_id all go if one is rejected, rows without one stay."""
    scores = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _reject(docs, scores.where("predicted = 0"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that ordinal regression finds toxic go; of rows that share a doc_id all go if one is rejected, rows without one stay."""
    scores = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _reject(docs, scores.where("toxic"))


def _once(docs: DataFrame) -> DataFrame:
    """One row of those with the same doc_id and text, the one with the least other values; rows without a doc_id stay."""
    twice = materialise(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return docs
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.join(twice, "doc_id", "left_semi")
    if others:
        one = rows.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("o")).select("doc_id", "text", "o.*")
    else:
        one = rows.select("doc_id", "text").distinct()
    return _reject(docs, twice).union(one.select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.8 of five-word shingles) the document with the smallest id stays, repeated rows once."""
    docs = _once(docs)
    groups = near_duplicates(docs, percent=80, bands=40, rows=6)
    return _reject(docs, groups.where("not kept"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start in two places are removed in all; n_chars is counted anew and no row goes.

    Rows are told apart by a number of their own; those that share a doc_id or have none are cut as any other. A null text stays null, as its n_chars.
    """
    number = next(c for c in (f"row_{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    cut = cut_repeats(rows.select(F.col(number).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), length=200, with_text=True)
    kept = cut.where("n_removed > 0").select(F.col("row").alias(number), F.col("kept_text").alias(f"{number}_text"))
    joined = rows.join(kept, number, "left").withColumn("text", F.coalesce(f"{number}_text", "text"))
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens are packed into sequences of 2048: one row a piece, see pack_documents()."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("packing", packing),
]

#: The stages run models and tokenizers that SQL can't express; tests/llm holds near_copies and repeats against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to documents; each stage's rows are written and read again."""
    with intermediate(spark) as keep:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES:
            with intermediate(spark) as stay:
                docs = stay(materialise(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        return keep(docs)

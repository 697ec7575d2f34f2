"""Scans over segments give what one window over the whole series gives."""

import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators import aggregates, evaluate, grid, segments, windows


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(3)
    rows = []
    for s, n in (("a", 700), ("b", 1), ("c", 40), (None, 90)):
        at = 0
        for i in range(n):
            at += 1 if rng.random() < 0.9 else rng.randint(50, 4000)  # bursts and gaps
            rows.append((s, at, None if rng.random() < 0.2 else 1e6 + rng.gauss(0, 1), i))
    df = spark.createDataFrame(rows, "series_id string, at long, y double, i long")
    return df.withColumn("ts", F.expr("timestamp_ntz'2024-03-30' + make_dt_interval(0, 0, 0, at)")).drop("at").cache()


def table(df, *cols):
    return sorted([tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.select("series_id", "i", *cols).collect()], key=str)


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-4)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("rows", [7, 64, 10**6])
def test_running_values(panel, rows):
    w = W.partitionBy("series_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    kinds = {"s": ("sum", F.sum), "c": ("count", F.count), "hi": ("max", F.max), "lo": ("min", F.min), "la": ("last", lambda v: F.last(v, ignorenulls=True))}
    got = segments.scan(panel, {n: (k, F.col("y")) for n, (k, _) in kinds.items()} | {"r": ("rows", F.lit(1))}, rows=rows)
    want = panel.withColumns({n: f(F.col("y")).over(w) for n, (_, f) in kinds.items()}).withColumn("r", F.count("*").over(w))
    near(table(got, *kinds, "r"), table(want, *kinds, "r"))
    assert got.columns == [*panel.columns, *kinds, "r"]


@pytest.mark.parametrize("rows", [9, 10**6])
def test_operators_agree_with_whole_windows(panel, rows):
    for cut, whole, cols in (
        (segments.expanding(panel, rows=rows), windows.expanding(panel), ("std", "n")),
        (segments.forward_fill(panel, rows=rows), grid.forward_fill(panel), ("y",)),
        (segments.cumulated(panel, "y", rows=rows), windows.cumulated(panel, "y"), ("total",)),
        (segments.variance_about_mean(panel, rows=rows), aggregates.variance_about_mean(panel), ("running_var",)),
    ):
        near(table(cut, *cols), table(whole, *cols))


def test_ranks_with_ties_and_empty_tables(panel):
    d = panel.withColumn("v", F.round("y") % 3)
    w = W.partitionBy("series_id").orderBy("v", "i")
    near(table(segments.ranked(d, "v", ("i",), rows=11), "place"), table(d.withColumn("place", F.row_number().over(w)), "place"))
    same = panel.withColumn("v", F.lit(1.0))
    near(table(segments.ranked(same, "v", ("i",), rows=11), "place"), table(same.withColumn("place", F.row_number().over(w)), "place"))
    assert segments.ranked(d.limit(0), "v", ("i",)).count() == 0


def test_one_series_runs_in_several_tasks(spark, panel):
    one = panel.where("series_id = 'a'")
    w = segments.scan(one, {"s": ("sum", F.col("y"))}, rows=20)
    spread = w.withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task").alias("n"))
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert spread.first()["n"] > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)


def test_tails_are_cut_before_the_shuffle(panel):
    plan = evaluate.tail(panel, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2

"""Neighbours in blocks against all pairs of delay vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import dynamics, manifold


def embed(y: np.ndarray, dims: int, delay: int) -> np.ndarray:
    n = len(y) - (dims - 1) * delay
    return np.column_stack([y[d * delay : d * delay + n] for d in range(dims)])


def cross_map(source: np.ndarray, target: np.ndarray, dims: int = 3, delay: int = 10, block: int = 512) -> float:
    """Correlation of source with its estimate from the target's manifold: k = dims + 1 nearest points, never the point itself."""
    e = embed(target, dims, delay)
    n, k = len(e), dims + 1
    guess = np.empty(n)
    for at in range(0, n, block):
        d = np.sqrt(np.maximum(((e[at : at + block, None] - e[None]) ** 2).sum(axis=2), 0))
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        w = 1 / (np.take_along_axis(d, near, 1) + 1e-9)
        guess[at : at + block] = (w / w.sum(axis=1, keepdims=True) * source[near]).sum(axis=1)
    return float(np.corrcoef(source[:n], guess)[0, 1])


def false_neighbours(y: np.ndarray, dims: int, delay: int = 1, ratio: float = 10.0, block: int = 512) -> float:
    """Pairs whose distance one step on is more than ratio times theirs, over the number of rows; both orders count."""
    e = embed(y, dims, delay)
    now, ahead = e[:-1], e[1:]
    hits = 0
    for at in range(0, len(now), block):
        d = np.sqrt(((now[at : at + block, None] - now[None]) ** 2).sum(axis=2)) + 1e-10
        hits += int((np.sqrt(((ahead[at : at + block, None] - ahead[None]) ** 2).sum(axis=2)) / d > ratio).sum())
    return hits / len(now)


def panel(spark, series):
    rows = [(s, i, float(y)) for s, v in series.items() for i, y in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, i long, y double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, CAST(i AS INT))")).drop("i")


@pytest.mark.parametrize("block", [16, 100_000])
def test_cross_maps_of_all_pairs(spark, block):
    u = dynamics.lorenz(900, 0.02)[500:]
    series = {"x": u[:, 0], "y": u[:, 1], "noise": np.random.default_rng(1).standard_normal(400), "steps": np.arange(400) % 3}
    got = {(r["source"], r["target"]): r["r"] for r in manifold.cross_maps(panel(spark, series), 3, 5, block=block).collect()}
    assert len(got) == 12 and got["y", "x"] > 0.9
    for (s, t), r in got.items():
        if "steps" not in (s, t):  # ties of distances are decided alike, but numpy's order of adding differs
            assert r == pytest.approx(cross_map(series[s], series[t], 3, 5), abs=1e-9)


def test_neighbours_are_the_nearest(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(50, 0.1, (150, 2)), [[200.0, 200.0]], np.zeros((20, 2))])
    rows = [("a", i, *map(float, p)) for i, p in enumerate(v)] + [("b", 0, 1.0, 1.0), ("b", 1, 2.0, 2.0), ("b", 2, None, 2.0)]
    df = spark.createDataFrame(rows, "series_id string, i long, e0 double, e1 double")
    got = {(r["series_id"], r["i"], r["rank"]): (r["j"], r["distance"]) for r in manifold.neighbours(df, ["e0", "e1"], 4, block=20).collect()}
    for i, p in enumerate(v):
        d = np.sqrt(((v - p) ** 2).sum(axis=1))
        d[i] = np.inf
        for rank, j in enumerate(np.lexsort((np.arange(len(v)), d))[:4], 1):
            assert got["a", i, rank] == (j, pytest.approx(d[j]))
    assert len(got) == 4 * len(v) + 2 and got["b", 0, 1][0] == 1


def test_far_blocks_never_meet(spark):
    rows = [("a", i, float(i)) for i in range(2000)]
    points = manifold.blocked(spark.createDataFrame(rows, "series_id string, i long, e0 double"), ["series_id"], ["e0"], 50)
    pairs = manifold.box_pairs(manifold.boxes(points, ["series_id"], ["e0"]), ["series_id"])
    near = pairs.where(manifold.least_distance(["e0"]) <= 10)
    assert points.groupBy("block").count().agg(F.max("count")).first()[0] <= 100
    assert near.count() * 4 < pairs.count()


@pytest.mark.parametrize("block", [16, 100_000])
def test_false_neighbours(spark, block):
    u = dynamics.lorenz(800, 0.02)[500:, 0]
    series = {"x": u, "noise": np.random.default_rng(3).standard_normal(200), "flat": np.zeros(50), "short": np.arange(3.0)}
    got = {(r["series_id"], r["dims"]): r["ratio"] for r in manifold.false_neighbour_ratios(panel(spark, series), 4, block=block).collect()}
    want = {(s, k): false_neighbours(v, k) for s, v in series.items() for k in range(1, 5) if len(v) > k}
    assert got == pytest.approx(want)
    assert manifold.false_neighbour_ratios(panel(spark, {"x": u}).limit(0)).count() == 0

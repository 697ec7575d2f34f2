"""Near-duplicate vectors by E8 lattice hashing, with exact cosines."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.arrow import slices
from chronoweave.llm.buckets import bucket_components
from chronoweave.llm.lattice import LatticeHash
from chronoweave.session import intermediate, materialise

#: Vectors of one side of a block of comparisons.
BLOCK = 512
#: Blocks of one side of a tile of blocks.
SIDE = 1024
#: Angles (radians) within this of the threshold are decided by the cosine itself.
SLACK = 1e-6


def _by_size(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a column of vectors the rows of each length, and those vectors as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _padded(column) -> np.ndarray:
    """Vectors as a matrix; shorter ones are filled up with zeros."""
    parts = list(_by_size(column))
    out = np.zeros((len(column), max((x.shape[1] for _, x in parts), default=0)))
    for rows, x in parts:
        out[rows, : x.shape[1]] = x
    return out


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _read(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, digest): a digest of the vector's bytes, null where it can't be linked."""

    def run(batches):
        for part in slices(batches, 1024):
            digests: list[bytes | None] = []
            for known, x in zip(part.column(0).is_valid().to_pylist(), part.column(1)):
                v = np.empty(0) if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # nulls are NaN, -0 is 0
                digests.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if known and len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary())], names=["vec_id", "x", "digest"])

    return vectors.mapInArrow(run, "vec_id long, x array<double>, digest binary")


def _filed(classes: DataFrame, tables: int, blocks: int, scale: float, probes: int) -> DataFrame:
    """(id, key) of every class in its lattice cells and those that touch them; lengths have keys of their own."""

    def run(batches):
        hasher = lru_cache(4)(lambda size: LatticeHash(size, tables, blocks, scale, probes))
        for part in slices(batches, 1024):
            for rows, x in _by_size(part.column(1)):
                keys = hasher(x.shape[1]).keys(_units(x)) + x.shape[1]
                ids = np.repeat(part.column(0).to_numpy()[rows], keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], names=["id", "key"])

    return classes.select("id", "x").mapInArrow(run, "id long, key long").distinct()


def _linked(pairs: DataFrame, cosine: float) -> DataFrame:
    """Of pairs (a, b, x, y) those whose vectors x and y have at least that cosine."""

    def run(batches):
        for part in slices(batches, 4096):
            same = (_units(_padded(part.column(2))) * _units(_padded(part.column(3)))).sum(axis=1) >= cosine if part.num_rows else []
            yield part.select([0, 1]).filter(pa.array(same, pa.bool_())).rename_columns(["u", "v"])

    return pairs.where(F.size("x") == F.size("y")).select("a", "b", "x", "y").mapInArrow(run, "u long, v long")


class CosineTest:
    """The pairs of a tile by their exact cosines."""

    def __init__(self, table: pa.Table, cosine: float):
        self.units, self.cosine = _units(_padded(table["x"])), cosine
        self.sizes = table["x"].combine_chunks().value_lengths().to_numpy()

    def likely(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        i, j = np.nonzero((self.units[a] @ self.units[b].T >= self.cosine) & (self.sizes[a][:, None] == self.sizes[b]))
        return list(zip(a[i].tolist(), b[j].tolist()))

    def same(self, i: int, j: int) -> bool:
        return i != j


def _sides(rows: DataFrame, k: str) -> DataFrame:
    """Deals rows (with a number h) of each group into k parts, and every two of them into a tile (i <= j): the rows with i, j and first (of part i)."""
    own = rows.withColumn("i_", F.pmod(F.col("h"), k).cast("int")).withColumn("j_", F.explode(F.sequence(F.lit(0), F.col(k) - 1)))
    return own.select("*", (F.col("i_") <= F.col("j_")).alias("first"), F.least("i_", "j_").alias("i"), F.greatest("i_", "j_").alias("j")).drop("i_", "j_")


def _coded(outer: DataFrame) -> DataFrame:
    """Adds code: ``depth`` bits that say on which sides of planes through its component's mean a vector lies."""

    def run(batches):
        planes = lru_cache(4)(lambda size: np.random.default_rng(size).standard_normal((size, 30)))
        for part in slices(batches, 1024):
            code = np.zeros(part.num_rows, np.int64)
            depth = part.column("depth").to_numpy()
            for (rows, x), (_, mean) in zip(_by_size(part.column("x")), _by_size(part.column("mean"))):
                bits = (_units(x) - mean) @ planes(x.shape[1]) > 0
                code[rows] = (bits * (1 << np.arange(30))).sum(axis=1) & ((1 << depth[rows]) - 1)
            yield part.select(["component", "id", "times", "x"]).append_column("code", pa.array(code))

    return outer.select("component", "id", "times", "x", "mean", "depth").mapInArrow(run, "component long, id long, times long, x array<double>, code long")


def _between_blocks(outer: DataFrame, cosine: float) -> DataFrame:
    """(id, others): links among the vectors of each component, without a comparison of all with all.

    outer: (component, id, times, x, mean, depth). A component is cut by planes through its mean and then
    into blocks of about BLOCK vectors, each with a centre and a radius. Two blocks whose
    centres are farther apart than the threshold and both radii are not compared; if even their
    farthest vectors are near enough, all are linked; only other pairs of blocks meet.
    """
    limit = math.acos(cosine)
    coded = materialise(_coded(outer), "coded")
    many = coded.groupBy("component", "code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    key = ["component", "code", "part"]
    placed = materialise(coded.join(many, ["component", "code"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("long")), "blocks")

    def sum_up(table: pa.Table) -> pa.Table:
        units = _units(_padded(table["x"]))
        centre = units.sum(axis=0)
        size = np.linalg.norm(centre)
        far = math.acos(max(-1.0, min(1.0, float((units @ (centre / size)).min())))) if size > 0 else math.pi
        row = {c: [table[c][0].as_py()] for c in key}
        return pa.table({**row, "centre": pa.array([(centre / size if size > 0 else centre).tolist()], pa.list_(pa.float64())), "far": [far], "total": [int(table["times"].to_numpy().sum())]})

    schema = "component long, code long, part long, centre array<double>, far double, total long"
    centres = materialise(placed.select(*key, "times", "x").groupBy(*key).applyInArrow(sum_up, schema), "centres")
    sides = centres.groupBy("component").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("k"))
    tiles = _sides(centres.join(sides, "component").withColumn("h", F.xxhash64("code", "part")), "k")

    def near(table: pa.Table) -> pa.Table:
        same = table["i"][0].as_py() == table["j"][0].as_py()
        first = table["first"].to_numpy(zero_copy_only=False)
        a = np.arange(table.num_rows) if same else np.flatnonzero(first)
        b = a if same else np.flatnonzero(~first)
        centre, far = _padded(table["centre"]), table["far"].to_numpy()
        apart = np.arccos(np.clip(centre[a] @ centre[b].T, -1, 1))
        reach = far[a][:, None] + far[b]
        meet = apart - reach <= limit + SLACK
        if same:
            meet &= np.arange(len(a))[:, None] <= np.arange(len(a))
        i, j = np.nonzero(meet)
        sure = (apart + reach)[i, j] <= limit - SLACK
        col = lambda c, rows: table[c].take(pa.array(rows))
        left, right = a[i], b[j]
        return pa.table([col("component", left), col("code", left), col("part", left), col("total", left), col("code", right), col("part", right), col("total", right), pa.array(sure)], names=["component", "code", "part", "total", "code2", "part2", "total2", "sure"])

    kinds = "component long, code long, part long, total long, code2 long, part2 long, total2 long, sure boolean"
    met = materialise(tiles.groupBy("component", "i", "j").applyInArrow(near, kinds).withColumn("pair", F.monotonically_increasing_id()), "met")
    itself = (F.col("code") == F.col("code2")) & (F.col("part") == F.col("part2"))
    sure = met.where("sure")
    gained = (
        sure.select(*key, F.col("total2").alias("n"), F.when(itself, 1).otherwise(0).alias("own"))
        .union(sure.where(~itself).select("component", F.col("code2").alias("code"), F.col("part2").alias("part"), "total", F.lit(0)))
        .groupBy(*key).agg(F.sum("n").alias("n"), F.max("own").alias("own"))
    )
    certain = placed.join(gained, key).select("id", (F.col("n") - F.col("own") * F.col("times")).alias("others"))
    unsure = met.where("not sure")
    left = placed.join(unsure.select(*key, "pair"), key).select("pair", "id", "times", "x", F.lit(True).alias("first"))
    right_key = unsure.where(~itself).select("component", F.col("code2").alias("code"), F.col("part2").alias("part"), "pair")
    right = placed.join(right_key, key).select("pair", "id", "times", "x", F.lit(False).alias("first"))

    def tile(table: pa.Table) -> pa.Table:
        ids, times, first = table["id"].to_numpy(), table["times"].to_numpy(), table["first"].to_numpy(zero_copy_only=False)
        unit = _units(_padded(table["x"]))
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        if not len(b):  # a block with itself
            linked = unit @ unit.T >= cosine
            np.fill_diagonal(linked, False)
            return pa.table({"id": ids, "others": linked @ times})
        linked = unit[a] @ unit[b].T >= cosine
        return pa.table({"id": np.concatenate([ids[a], ids[b]]), "others": np.concatenate([linked @ times[b], linked.T @ times[a]])})

    return certain.union(left.union(right).groupBy("pair").applyInArrow(tile, "id long, others long"))


def _direct_links(classes: DataFrame, cosine: float) -> DataFrame:
    """(id, others): how many vectors of other classes each class is linked with.

    classes: (id, component, times, x), components of more than one class. Angles
    obey the triangle inequality: where a class's angle to its component's mean and
    the largest such angle add up to less than the threshold, it is linked with
    all others and nothing is compared. The rest of a component are compared with
    each other only, see _between_blocks().
    """
    limit = math.acos(cosine) - SLACK
    dim = F.posexplode(F.col("unit")).alias("d", "value")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    units = classes.withColumn("unit", F.transform("x", lambda v: v / norm))
    mean = (
        units.select("component", dim).groupBy("component", "d").agg(F.avg("value").alias("s"))
        .groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda v: v["s"]).alias("mean"))
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cos = F.coalesce(F.try_divide(dot("unit", "mean"), F.sqrt(dot("mean", "mean"))), F.lit(-1.0))
    placed = materialise(units.join(mean, "component").withColumn("angle", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))).drop("unit"), "angles")
    whole = materialise(placed.groupBy("component").agg(F.max("angle").alias("far"), F.sum("times").alias("all")), "whole")
    placed = materialise(placed.join(whole, "component").withColumn("inner", F.col("angle") + F.col("far") <= limit), "placed")
    sure = placed.where("inner").select("id", (F.col("all") - F.col("times")).alias("others"))
    outer = placed.where("not inner")
    sides = materialise(outer.groupBy("component").agg(F.sum("times").alias("outside"), F.greatest(F.lit(0), F.least(F.lit(30), F.ceil(F.log2(F.count("*") / BLOCK)))).cast("int").alias("depth")), "sides")
    outer = outer.join(sides, "component")
    inside = outer.select("id", (F.col("all") - F.col("outside")).alias("others"))
    return sure.union(_between_blocks(outer, cosine)).union(inside).groupBy("id").agg(F.sum("others").alias("others"))


def near_vectors(
    vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = 10, blocks: int = 2, scale: float = 0.7, probes: int = 4,
) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable) and kept.

    Vectors are linked where their cosine in double precision is at least
    ``cosine``. Candidates share a lattice cell of some table, their own or one
    of ``probes`` that touch it; equal vectors are one class. Within a component all
    links are counted exactly. With the default tables about one pair in 200 at
    0.95 (less above) shares no cell; a link is lost only if its two vectors are
    not joined by other links either.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those
    with a null vec_id, link with nothing and are kept; vectors of different lengths
    are not linked. Rows that share a vec_id are vectors of their own, each in its own
    component; repeated rows are linked with each other. Further columns don't matter; no rows give no rows.
    """
    with intermediate(vectors.sparkSession) as keep:
        rows = _read(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")))
        rows = materialise(rows, "vectors")
        good = rows.where("digest is not null")
        owner = materialise(good.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times")), "owners")
        once = good.join(owner, ["digest", "vec_id"]).dropDuplicates(["digest"])
        classes = materialise(once.withColumn("id", F.monotonically_increasing_id()), "classes")  # vec_ids may repeat, these numbers don't
        of = lambda c, v: classes.select(F.col("id").alias(c), F.col("x").alias(v))
        check = lambda pairs: materialise(_linked(pairs.join(of("b", "y"), "b").join(of("a", "x"), "a"), cosine), "verified")
        payload = lambda ids: classes.select("id", "x").join(ids, "id")
        found = bucket_components(_filed(classes, tables, blocks, scale, probes), check, payload, lambda table: CosineTest(table, cosine))
        links = _direct_links(classes.select("id", "times", "x").join(found, "id"), cosine)
        low = classes.join(found, "id").groupBy("component").agg(F.min("vec_id").alias("low"))
        known = classes.select("digest", "id", "times", F.col("vec_id").alias("rep")).join(found, "id", "left").join(low, "component", "left").join(links, "id", "left")
        known = materialise(known.select("digest", "times", "rep", "low", "others"), "known")
        out = rows.select("vec_id", "digest").join(known, "digest", "left")
        component = F.coalesce("low", "rep", "vec_id")
        n = F.coalesce(F.col("others"), F.lit(0)) + F.coalesce(F.col("times") - 1, F.lit(0))
        return keep(out.select("vec_id", n.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")))

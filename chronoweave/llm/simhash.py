"""SimHash fingerprints, and all fingerprints within a Hamming radius from permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.arrow import map_texts, slices, with_id_and_text
from chronoweave.llm.buckets import bucket_components
from chronoweave.llm.hashing import WordCodes, constants, mix, words_of
from chronoweave.session import intermediate, materialise

_U = np.uint64


class SimHash:
    """Fingerprints of ``bits`` bits (a multiple of 64).

    Terms are words and pairs of neighbouring words, A-Z in lower case. Each term's hash
    votes on every bit for 1 or -1 with the term's weight, the fourth root of how often it
    occurs, so that a few very common words don't decide; a bit is 1 if the votes' sum is above 0. A text without words has
    the fingerprint of no votes, all zeros.
    """

    def __init__(self, bits: int = 256):
        self.lanes = constants(bits // 64, 21)
        self.codes = WordCodes()

    def terms(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text its distinct terms' hashes and their weights."""
        out = []
        with np.errstate(over="ignore"):
            for h in (self.codes.of(words_of(t)) for t in texts):
                pairs = mix(h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:])
                used, times = np.unique(np.concatenate([h, pairs]), return_counts=True)
                out.append((used, (times**0.25).astype(np.float32)))
        return out

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """A row of bits / 8 bytes per text."""
        out = np.zeros((len(texts), len(self.lanes) * 8), np.uint8)
        with np.errstate(over="ignore"):
            for i, (used, weight) in enumerate(self.terms(texts)):
                votes = np.zeros(len(self.lanes) * 64, np.float64)
                for at in range(0, len(used), 4096):
                    hashes = mix(used[at : at + 4096, None] ^ self.lanes)
                    w = weight[at : at + 4096]
                    votes += 2.0 * (w @ np.unpackbits(hashes.view(np.uint8), axis=1).astype(np.float32)) - w.sum()
                out[i] = np.packbits(votes > 1e-3)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits of rows of bytes."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / (8.0 * a.shape[1])


def fingerprint(docs: DataFrame, bits: int = 256) -> DataFrame:
    """doc_id and fingerprint (lowercase hex) of every row of docs; equal texts have equal fingerprints."""

    def make():
        hasher = SimHash(bits)

        def work(ids, texts):
            return [pa.array(ids, pa.int64()), pa.array([x.tobytes().hex() for x in hasher.fingerprints(texts)], pa.string())]

        return work

    return map_texts(with_id_and_text(docs), make, "doc_id long, fingerprint string", ["doc_id", "fingerprint"])


class BitTest:
    """The pairs of a tile by their bits."""

    def __init__(self, table: pa.Table, radius: int):
        raw = bytes.fromhex("".join(table["fingerprint"].to_pylist()))
        self.bits, self.radius = np.frombuffer(raw, np.uint8).reshape(table.num_rows, -1), radius

    def likely(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        i, j = np.nonzero(np.bitwise_count(self.bits[a][:, None] ^ self.bits[b]).sum(axis=2) <= self.radius)
        return list(zip(a[i].tolist(), b[j].tolist()))

    def same(self, i: int, j: int) -> bool:
        return i != j


def within_radius(prints: DataFrame, radius: int, bits: int = 256, together: int = 1) -> DataFrame:
    """(doc_id, fingerprint, component_id): groups of fingerprints linked by at most ``radius`` different bits.

    The bits, dealt out by a fixed permutation, are cut into radius + together blocks: two fingerprints within the
    radius differ in at most ``radius`` of them and agree in ``together`` whole ones. There is a table for every choice of so many
    blocks, keyed by their bits, so that they meet in one of the tables; more blocks together make keys longer, and buckets of
    unlike texts rarer, for more tables. Equal fingerprints are one class; a table's
    bucket is compared as bucket_components() says.
    """
    order = np.random.default_rng(13).permutation(bits)
    cuts = np.array_split(order, radius + together)
    choices = list(combinations(range(len(cuts)), together))
    classes = materialise(prints.where(F.col("doc_id").isNotNull() & F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "classes")

    def tables(batches):
        names, widths = constants(len(choices), 31), [np.uint64(1) << np.arange(len(cut), dtype=np.uint64) for cut in cuts]
        for part in slices(batches):
            raw = np.frombuffer(bytes.fromhex("".join(part.column(1).to_pylist())), np.uint8).reshape(part.num_rows, -1)
            each = np.unpackbits(raw, axis=1)
            codes = [each[:, cut].astype(np.uint64) @ width for cut, width in zip(cuts, widths)]
            with np.errstate(over="ignore"):
                for choice, name in zip(choices, names):
                    key = np.full(part.num_rows, name)
                    for block in choice:
                        key = mix(key + codes[block])
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key.view(np.int64))], names=["id", "key"])

    banded = classes.select("id", "fingerprint").mapInArrow(tables, "id long, key long")
    of = lambda c: classes.select(F.col("id").alias(c), F.col("fingerprint").alias(f"f_{c}"))
    lanes = [(1 + k, min(15, bits // 4 - k)) for k in range(0, bits // 4, 15)]  # 60 bits each fit a long
    number = lambda c, at, n: F.conv(F.substring(c, at, n), 16, 10).cast("long")
    apart = sum((F.bit_count(number("f_a", at, n).bitwiseXOR(number("f_b", at, n))) for at, n in lanes), F.lit(0))
    check: Callable[[DataFrame], DataFrame] = lambda pairs: materialise(
        pairs.join(of("b"), "b").join(of("a"), "a").where(apart <= radius).select(F.col("a").alias("u"), F.col("b").alias("v")), "verified"
    )
    payload = lambda ids: classes.select("id", "fingerprint").join(ids, "id")
    found = bucket_components(banded, check, payload, lambda table: BitTest(table, radius))
    named = prints.join(classes, "fingerprint", "left").join(found, "id", "left")
    return named.select("doc_id", "fingerprint", F.coalesce("component", "id", "doc_id").alias("component_id"))


def near_fingerprints(docs: DataFrame, radius: int = 16, bits: int = 256, together: int = 2) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs: fingerprints linked by at most ``radius`` different bits.

    Every text is hashed once. A component is named by the smallest doc_id that has one of its fingerprints; texts
    without words, null and empty ones included, share the fingerprint of no votes
    and are one group. A row without a doc_id doesn't name a group; if no other row has its
    fingerprint, its component is null. Rows that share a doc_id have a line each.
    Further columns don't matter; no rows give no rows. Near copies' fingerprints lie some 14 to 25 bits apart, so that a radius of 16
    finds the nearer ones; its 18 blocks make 153 tables keyed by two blocks, 28 bits, which keeps buckets of unlike
    texts small up to a hundred million different fingerprints (three together, 40 bits and 969 tables beyond).
    """
    with intermediate(docs.sparkSession) as keep:
        prints = materialise(fingerprint(docs, bits), "prints")
        return keep(materialise(within_radius(prints, radius, bits, together), "groups"))


_PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, bits: int = 256, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text, its edited text and their likeness.

    In descending order of doc_id each text's last floor(n_chars / 2) characters are
    replaced by the first as many (or all) of the next text, the last one's by those
    of the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (likeness of its fingerprint to the
    edited text's and to the next text's).

    The rows are dealt out once, to ``ranges`` ranges of ids (four for each shuffle
    partition); the first row of a range is also the last of the range before
    it, so that each task has the neighbours of all its rows. Only the ranges' cuts
    and first ids go to the driver. A null text counts as empty; rows with a null
    doc_id come last; rows that share a doc_id are in the order of their texts' hashes;
    a single row is its own next. Further columns don't matter; no rows give no rows.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = with_id_and_text(docs)
    if docs.isEmpty():
        return spark.createDataFrame([], _PAIRED)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    shares = [i / ranges for i in range(1, ranges)]
    found = texts.select(key.alias("k")).stat.approxQuantile("k", shares, 0.25 / ranges) if shares else []
    cuts = np.unique(np.array(found, np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right").astype(np.int32))

    dealt = texts.withColumn("range_", range_of(key))
    tops = sorted((r["range_"], r["top"]) for r in dealt.groupBy("range_").agg(F.max(key).alias("top")).collect())
    heads = [(r, top, tops[(i + 1) % len(tops)][0]) for i, (r, top) in enumerate(tops)]
    heads = spark.createDataFrame(heads, "range_ int, top_ long, to_ int")
    first = dealt.join(F.broadcast(heads), (dealt["range_"] == heads["range_"]) & (key == F.col("top_")))
    both = dealt.withColumn("head", F.lit(False)).union(first.select("doc_id", "text", "to_", F.lit(True)))
    placed = both.repartition("range_").sortWithinPartitions("range_", "head", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())

    def run(batches):
        hasher = SimHash(bits)
        held: list = []

        def out(rows, after):
            ids, texts = [r[0] for r in rows], [r[1] for r in rows]
            nexts = [*texts[1:], after]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts)]
            own = hasher.fingerprints([*texts, after])
            new = hasher.fingerprints(edited)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([x.tobytes().hex() for x in own[:-1]]), pa.array([x.tobytes().hex() for x in new]), pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:])),
                ],
                names=[f.split()[0] for f in _PAIRED.split(", ")],
            )

        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for row in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if row[3]:  # the first row of the next range ends this one; further such rows are copies of it
                        if held:
                            yield out(held, row[1])
                        held = []
                        continue
                    held.append(row)
                    if len(held) > 256:
                        yield out(held[:256], held[256][1])
                        held = held[256:]

    return placed.select("doc_id", "text", "range_", "head").mapInArrow(run, _PAIRED)


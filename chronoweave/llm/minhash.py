"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

from hashlib import sha256
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.arrow import slices, with_id_and_text
from chronoweave.llm.buckets import bucket_components
from chronoweave.llm.hashing import Shingler, common_shingles, constants, mix, words_of
from chronoweave.session import intermediate, materialise

#: Ids that are broadcast at most (8 MB); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000


class Signer:
    """MinHash signatures of bands * rows values and a 64-bit key of each band."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.a = (constants(n, seed) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.b = (constants(n, seed + 1) >> np.uint64(32)).astype(np.uint32)
        self.r = constants(rows, seed + 2)
        self.band = constants(bands, seed + 3)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 1024):
            low = np.minimum(low, (x[at : at + 1024, None] * self.a + self.b).min(axis=0))
        return low

    def keys(self, signature: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            parts = mix(signature.astype(np.uint64).reshape(self.bands, self.rows) + self.r) * self.r
            return mix(parts.sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a SHA-256 of the sequence of words, the band keys and the signature (16 bits a value)."""

    def run(batches):
        shingler, signer = Shingler(words), Signer(bands, rows)
        for part in slices(batches):
            split = [words_of(t) for t in part.column(1).to_pylist()]
            digest = pa.array([sha256(b" ".join(w)).digest() for w in split], pa.binary())
            sets = [shingler.shingles(w) for w in split]
            low = [signer.signature(s) for s in sets]
            keys = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands, np.concatenate([signer.keys(x) for x in low]))
            brief = pa.array([x.astype(np.uint16).tobytes() for x in low], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), digest, keys, brief], names=["doc_id", "n_shingles", "digest", "keys", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, sig binary")


def fewest_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest of n equal values with which P(similarity >= threshold) is at least miss.

    With an even prior the posterior after m of n matches is Beta(m + 1, n - m + 1),
    whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def plausible(pairs: DataFrame, size: int, batch: int, threshold: float, miss: float) -> DataFrame:
    """Of pairs (a, b, sig_a, sig_b) those that no batch of the signatures has ruled out: (a, b)."""
    steps = [(k, fewest_matches(k, threshold, miss)) for k in range(batch, size + 1, batch)]

    def run(batches):
        for part in slices(batches, 8192):
            alive = np.arange(part.num_rows)
            left, right = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, size) for c in (2, 3))
            same = np.zeros(part.num_rows, np.int64)
            for k, least in steps:
                same = same + (left[alive, k - batch : k] == right[alive, k - batch : k]).sum(axis=1)
                alive, same = alive[same >= least], same[same >= least]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(alive)), part.column(1).take(pa.array(alive))], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


class TextTest:
    """The pairs of a tile by their signatures, batch after batch, then by hashes of their shingles, then by the words themselves."""

    def __init__(self, table: pa.Table, words: int, size: int, batch: int, percent: int, miss: float):
        self.sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, size)
        self.n, self.texts = table["n"].to_numpy(), table["text"]
        self.words, self.batch, self.percent = words, batch, percent
        self.shingler, self.sets = Shingler(words), {}
        self.steps = [(k, fewest_matches(k, percent / 100, miss)) for k in range(batch, size + 1, batch)]

    def likely(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        low, high = np.minimum(self.n[a][:, None], self.n[b]), np.maximum(self.n[a][:, None], self.n[b])
        i, j = np.nonzero(100 * low >= self.percent * high)
        i, j = a[i], b[j]
        same = np.zeros(len(i), np.int64)
        for k, least in self.steps:
            same = same + (self.sig[i, k - self.batch : k] == self.sig[j, k - self.batch : k]).sum(axis=1)
            i, j, same = i[same >= least], j[same >= least], same[same >= least]
        order = np.argsort(-same, kind="stable")
        return list(zip(i[order].tolist(), j[order].tolist()))

    def hashes(self, i: int) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = self.shingler.shingles(words_of(self.texts[i].as_py()))
        return self.sets[i]

    def same(self, i: int, j: int) -> bool:
        common = len(np.intersect1d(self.hashes(i), self.hashes(j), assume_unique=True))
        if 100 * common < self.percent * (self.n[i] + self.n[j] - common):
            return False
        return linked(words_of(self.texts[i].as_py()), words_of(self.texts[j].as_py()), self.words, self.percent)


def linked(a: list[bytes], b: list[bytes], words: int, percent: int) -> bool:
    """Whether two texts' sets of shingles have at least percent of their union in common."""
    n, m, common = common_shingles(a, b, words)
    return 100 * common >= percent * (n + m - common)


class Verifier:
    """Decides pairs of documents by the words of their shingles; keeps the texts of documents whose pairs got that far."""

    def __init__(self, docs: DataFrame, base: DataFrame, words: int, size: int, batch: int, percent: int, miss: float):
        self.docs, self.words, self.percent = docs, words, percent
        self.prune = lambda pairs: plausible(pairs, size, batch, percent / 100, miss)
        self.sigs = base.select("doc_id", F.col("n_shingles").alias("n"), "sig")
        self.texts: DataFrame | None = None

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked, as a written table (u, v)."""
        of = lambda c: self.sigs.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
        near = (
            pairs.join(of("b"), "b").join(of("a"), "a")
            .where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
            .select("a", "b", "sig_a", "sig_b")
        )
        left = materialise(self.prune(near), "plausible")
        self.fetch(left)
        of = lambda c: self.texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
        words, percent = self.words, self.percent

        def run(batches):
            for part in slices(batches):
                texts = zip(part.column(2).to_pylist(), part.column(3).to_pylist())
                yes = [linked(words_of(x), words_of(y), words, percent) for x, y in texts]
                yield part.select([0, 1]).filter(pa.array(yes, pa.bool_())).rename_columns(["u", "v"])

        both = left.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b")
        return materialise(both.mapInArrow(run, "u long, v long"), "verified")

    def payload(self, ids: DataFrame) -> DataFrame:
        """(id, sig, n, text) of ids (id)."""
        self.fetch(ids.select(F.col("id").alias("a"), F.col("id").alias("b")))
        wanted = ids.join(self.texts.withColumnRenamed("doc_id", "id"), "id")
        return wanted.join(self.sigs.withColumnRenamed("doc_id", "id"), "id")

    def fetch(self, pairs: DataFrame) -> None:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        if self.texts is not None:
            ids = ids.join(self.texts, "doc_id", "left_anti")
        ids = materialise(ids, "ids")
        n = ids.count()
        if n == 0 and self.texts is not None:
            return
        new = materialise(self.docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi"), "texts")
        self.texts = new if self.texts is None else self.texts.unionByName(new)


def near_duplicates(
    docs: DataFrame, percent: int = 80, words: int = 5, bands: int = 32, rows: int = 8, batch: int = 32, miss: float = 1e-6
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept.

    Documents are linked where 100 * |common shingles| >= percent * |union|; each link
    is confirmed on the words themselves. Texts with the same words in a row (by SHA-256) are one class; the
    classes that share a band's key are compared as
    bucket_components() says. With 32 bands of 8 rows a pair at 0.85 is in no common
    bucket with a chance of 4e-5, at 0.8 of 2e-3 (use rows=6 for 3e-5 there);
    a batch prunes a pair above the threshold with a chance of about ``miss``.
    n_shingles counts 64-bit hashes of a text's shingles, which collide in a text of 20,000
    words with a chance of 1e-11.

    A null or empty text, or one of white space, has no shingles and links with
    nothing. Rows that share a doc_id count as one document. A null doc_id links
    with nothing and is kept. Very long texts are compared whole. Further columns don't matter; no rows give no rows.
    """
    texts = with_id_and_text(docs)
    with intermediate(docs.sparkSession) as keep:
        base = materialise(signed(texts, words, bands, rows), "signed")
        some = base.where("n_shingles > 0 and doc_id is not null")
        # classes is a table of its own, so that Spark can split the rows of a hot one in the join
        classes = materialise(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
        kept = some.select("doc_id", "n_shingles", "digest").join(classes, "digest").drop("digest")
        alone = base.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("rep"))
        members = materialise(kept.union(alone), "members")
        reps = members.where("doc_id = rep").select("doc_id").distinct()
        banded = some.select("doc_id", "keys").join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
        verifier = Verifier(texts, some, words, bands * rows, batch, percent, miss)
        twice = members.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("top")).where("v <> top")
        known = members.join(twice, "doc_id").select(F.col("rep").alias("u"), "v").where("u <> v")  # one doc_id, several texts
        test = lambda table: TextTest(table, words, bands * rows, batch, percent, miss)
        found = bucket_components(banded, verifier.links, verifier.payload, test, known)
        out = members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
        component = F.coalesce("component", "rep", "doc_id")
        return keep(out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))

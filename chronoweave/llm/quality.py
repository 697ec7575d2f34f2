"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.arrow import map_texts, slices, with_id_and_text
from chronoweave.llm.samples import fold, labelled_sample

_TERM = re.compile(r"[^\W_]+|[^\w\s]+|_+")
SHAPES = 8


@dataclass(frozen=True)
class Space:
    """The random-indexing space: words are hashed to ``buckets`` rows of ``dim`` numbers.

    A bucket's index vector has ``ones`` entries of 1 or -1 at random places; a
    word's vector is the sum of its neighbours' index vectors, at most ``window``
    words away, over the whole corpus. The table's size doesn't depend on the corpus.
    """

    buckets: int = 1 << 15
    dim: int = 32
    ones: int = 4
    window: int = 2

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(3)
        return rng.integers(0, self.dim, (self.buckets, self.ones)), rng.choice([-1.0, 1.0], (self.buckets, self.ones))

    def index_vectors(self) -> np.ndarray:
        place, sign = self.index()
        out = np.zeros((self.buckets, self.dim), np.float32)
        np.add.at(out, (np.arange(self.buckets)[:, None], place), sign)
        return out


def _shape(term: str) -> int:
    if not term[0].isalnum():
        return 0 if len(term) == 1 else 1
    if term.isdigit():
        return 2
    if term.islower():
        return 3
    if term.isupper():
        return 4 if len(term) == 1 else 5
    return 6 if term[0].isupper() and term[1:].islower() else 7


class Terms(dict):
    """Of each term bucket * SHAPES + shape, worked out once; started anew when it has grown too large."""

    def __init__(self, buckets: int, most: int = 400_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, term: str) -> int:
        self[term] = code = zlib.crc32(term.lower().encode()) % self.buckets * SHAPES + _shape(term)
        return code

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, shapes and the number of each text's terms, for all texts in a row."""
        if len(self) > self.most:
            self.clear()
        split = [_TERM.findall(t) for t in texts]
        n = np.array([len(s) for s in split])
        flat = np.fromiter((self[t] for s in split for t in s), np.int64, int(n.sum()))
        return *np.divmod(flat, SHAPES), n


def word_vectors(docs: DataFrame, space: Space = Space()) -> np.ndarray:
    """The word vectors of all texts (buckets x dim, of length 1): tasks send one row for each bucket they have seen."""

    def run(batches):
        terms, (place, sign) = Terms(space.buckets), space.index()
        total = np.zeros(space.buckets * space.dim)
        for part in slices(batches):
            words, _, n = terms.codes(part.column(1).to_pylist())
            doc = np.repeat(np.arange(len(n)), n)
            for step in range(1, space.window + 1):
                same = doc[step:] == doc[:-step]
                left, right = words[:-step][same], words[step:][same]
                for of, near in ((left, right), (right, left)):
                    at = (of[:, None] * space.dim + place[near]).ravel()
                    total += np.bincount(at, sign[near].ravel(), len(total))
        table = total.reshape(space.buckets, space.dim)
        seen = np.flatnonzero(table.any(axis=1))
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(table[seen, d]) for d in range(space.dim))], names=["bucket", *(f"v{d}" for d in range(space.dim))])

    schema = "bucket long, " + ", ".join(f"v{d} double" for d in range(space.dim))
    sums = docs.mapInArrow(run, schema).groupBy("bucket").agg(*(F.sum(f"v{d}").alias(f"v{d}") for d in range(space.dim))).toPandas()
    out = np.zeros((space.buckets, space.dim), np.float32)
    out[sums["bucket"].to_numpy()] = sums.drop(columns="bucket").to_numpy()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


class Pooler:
    """A text's features: means over its terms of the words' vectors, their index vectors and the terms' shapes."""

    def __init__(self, vectors: np.ndarray, space: Space):
        self.terms = Terms(space.buckets)
        self.table = np.concatenate([vectors, space.index_vectors()], axis=1).astype(np.float32)

    def features(self, texts: list[str]) -> np.ndarray:
        words, shapes, n = self.terms.codes(texts)
        out = np.zeros((len(texts), self.table.shape[1] + SHAPES + 1), np.float32)
        at = 0
        for i, k in enumerate(n):
            if k:
                # equal words are looked up once
                used, times = np.unique(words[at : at + k], return_counts=True)
                out[i, : self.table.shape[1]] = (times / k).astype(np.float32) @ self.table[used]
                out[i, -SHAPES - 1 : -1] = np.bincount(shapes[at : at + k], minlength=SHAPES) / k
                out[i, -1] = 1.0
            at += k
        return out


class Network:
    """Two layers: tanh units, then one logit; Adam on the mean log loss with a fixed seed."""

    def __init__(self, hidden: int = 32, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 0):
        self.hidden, self.epochs, self.rate, self.decay, self.seed = hidden, epochs, rate, decay, seed
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Every fifth row is left out of the fit and sets the temperature."""
        rng = np.random.default_rng(self.seed)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.std
        aside = np.arange(len(x)) % 5 == 4
        shape = [(x.shape[1], self.hidden), (self.hidden,), (self.hidden,), ()]
        self.p = [rng.standard_normal(shape[0]) / np.sqrt(x.shape[1]), np.zeros(shape[1]), rng.standard_normal(shape[2]) / np.sqrt(self.hidden), np.zeros(shape[3])]
        m, v, t = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape], 0
        rows = np.flatnonzero(~aside)
        for _ in range(self.epochs):
            rng.shuffle(rows)
            for at in range(0, len(rows), 256):
                b = rows[at : at + 256]
                w1, b1, w2, b2 = self.p
                h = np.tanh(x[b] @ w1 + b1)
                g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y[b]) / len(b)
                back = np.outer(g, w2) * (1 - h * h)
                grads = [x[b].T @ back + self.decay * w1, back.sum(axis=0), h.T @ g + self.decay * w2, g.sum()]
                t += 1
                for i, d in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    self.p[i] = self.p[i] - self.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if aside.any():
            z, want = self.logits(x[aside], scaled=True), y[aside]
            grid = np.geomspace(0.25, 8, 61)
            loss = [np.mean(np.logaddexp(0, z / k) - want * z / k) for k in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def logits(self, x: np.ndarray, scaled: bool = False) -> np.ndarray:
        x = x if scaled else (x - self.mean) / self.std
        w1, b1, w2, b2 = self.p
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def score_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "quality", most: int = 20_000, space: Space = Space(), threshold: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold).

    Word vectors come from all texts; the network is fitted on at most ``most``
    labelled rows (doc_id, label) for which ``train`` holds, by default those whose
    crc32 of the doc_id as text isn't 2 mod 4. Only texts go into a score. A null or
    empty text has the features of no term and a score as any other; without
    labels of both kinds every score is the labels' mean (0.5 without any). Rows
    repeat as in docs; a null doc_id stays null and isn't learnt from. Rows that share a doc_id are each
    scored by their own text and each learnt from with that id's label; of several labels for one doc_id each counts.
    Further columns don't matter. Words share ``space.buckets`` hashed rows, which bounds the table; in
    a corpus of very many words a row stands for all words of its bucket, mostly for its commonest.
    """
    texts = with_id_and_text(docs)
    train = fold("doc_id", 4) != 2 if train is None else train
    sample = labelled_sample(labels, label, train, most)
    vectors = word_vectors(texts, space)

    def pooled(batches):
        pooler = Pooler(vectors, space)
        for part in slices(batches):
            x = pooler.features(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    rows = texts.join(F.broadcast(sample), "doc_id").mapInArrow(pooled, "doc_id long, y int, x array<float>").toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy(np.float64)
    model = Network().fit(np.array(rows["x"].tolist(), np.float64), y) if len(set(y)) == 2 else None
    flat = float(y.mean()) if len(y) else 0.5

    def make():
        pooler = Pooler(vectors, space)

        def work(ids, texts):
            p = model.probability(pooler.features(texts).astype(np.float64)) if model else np.full(len(ids), flat)
            return [pa.array(ids, pa.int64()), pa.array(p)]

        return work

    out = map_texts(texts, make, "doc_id long, score double", ["doc_id", "score"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

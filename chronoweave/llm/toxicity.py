"""Toxicity: cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.arrow import map_texts, slices, with_id_and_text
from chronoweave.llm.samples import fold, labelled_sample
from chronoweave.session import intermediate, materialise

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class OrdinalRegression:
    """P(grade > k) = sigmoid(w . x - t_k), one w for all k and t_0 < t_1 < ...

    The gaps between thresholds are exponentials, so that their order holds by
    itself. Fitted by full-batch Adam on the mean negative log likelihood with an
    L2 penalty on w; x is sparse (rows, columns, values).
    """

    def __init__(self, grades: int, decay: float = 1e-4, steps: int = 400, rate: float = 0.1):
        self.grades, self.decay, self.steps, self.rate = grades, decay, steps, rate

    def thresholds(self) -> np.ndarray:
        return self.cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(self.cuts[1:]))])

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds(), -30, 30)))

    def fit(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, width: int, y: np.ndarray) -> OrdinalRegression:
        self.w, self.cuts = np.zeros(width), np.zeros(self.grades - 1)
        p = [self.w, self.cuts]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        at = np.arange(n)
        for t in range(1, self.steps + 1):
            z = np.bincount(rows, self.w[cols] * values, n)
            s = np.concatenate([np.ones((n, 1)), self.above(z), np.zeros((n, 1))], axis=1)
            d = s * (1 - s)
            mass = np.maximum(s[at, y] - s[at, y + 1], 1e-12)  # P(grade = y)
            low, high = d[at, y] / mass, d[at, y + 1] / mass  # of -log mass by the thresholds below and above y
            gz = -(low - high) / n
            gt = np.zeros(self.grades + 1)
            np.add.at(gt, y, low / n)
            np.add.at(gt, y + 1, -high / n)
            gt = gt[1:-1]
            tail = np.cumsum(gt[::-1])[::-1]
            grads = [np.bincount(cols, gz[rows] * values, width) + self.decay * self.w, np.concatenate([tail[:1], tail[1:] * np.exp(self.cuts[1:])])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= self.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


def _telling_words(sample: DataFrame, features: int, least: int) -> list[tuple[str, float]]:
    """The words whose share of documents differs most between the classes, by the z value of their log odds."""

    def run(batches):
        for part in slices(batches):
            words, y = [], []
            for text, label in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                found = set(words_of(text))
                words += found
                y += [label] * len(found)
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(y, pa.int32())], names=["word", "y"])

    counts = sample.mapInArrow(run, "word string, y int").groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    n = sample.agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).first()
    bad, good = n["bad"] or 0, n["good"] or 0
    odds = F.log((F.col("bad") + 0.5) / (bad - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (good - F.col("good") + 0.5))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    rows = counts.where(F.col("bad") + F.col("good") >= least).select("word", (odds / spread).alias("z")).where(F.abs("z") >= 2)
    return [(r["word"], r["z"]) for r in rows.orderBy(F.abs("z").desc(), "word").limit(features).collect()]


def counted(place: dict[str, int], text: str) -> tuple[list[int], list[int]]:
    """The places of a text's features and how often each occurs: at most one entry a feature, however long the text is."""
    n = Counter(place[w] for w in words_of(text) if w in place)
    return list(n), list(n.values())


def score_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "toxic", most: int = 20_000, features: int = 2048, least: int = 5, z: float = 3.0, threshold: float = 0.5
) -> DataFrame:
    """Per row of docs: doc_id, expected_severity (0 to 3), grade (0 to 3), p_toxic and toxic (p_toxic >= threshold).

    Features are the words that tell the classes apart: of those in at least ``least`` labelled
    rows with |z| >= 2 (log odds of the classes) the ``features`` with the largest |z|; other words
    have no weight. Values are log(1 + count), counted over whole texts.

    Labels say toxic or not; the grades to learn are 0 for clean rows and, for
    toxic ones, 1 to 3 by thirds of how often words occur that tell of toxicity (z at
    least ``z``). So grades above 0 say how much telling language a toxic row holds, which is
    all that such labels bear out; only grade 0 against the others is learnt from people's marks.

    Vocabulary, grades and weights come from at most ``most`` labelled rows for which ``train`` holds (by
    default those whose crc32 of the doc_id as text isn't 2 mod 4); at most ``features`` entries of each go to the
    driver. A null or empty text has no words and the score of one; without labels of both kinds
    severity is 0 and nothing is toxic. Rows repeat as in docs; a null doc_id stays
    null and isn't learnt from. Rows that share a doc_id are each scored by their own text and each learnt from with that id's
    label; of several labels for one doc_id each counts. Further columns don't matter.
    """
    texts = with_id_and_text(docs)
    train = fold("doc_id", 4) != 2 if train is None else train
    with intermediate(docs.sparkSession):
        sample = materialise(texts.join(F.broadcast(labelled_sample(labels, label, train, most)), "doc_id"), "sample")
        telling = _telling_words(sample, features, least)
        place = {w: i for i, (w, _) in enumerate(telling)}

        def sparse(batches):
            for part in slices(batches):
                at, n = zip(*(counted(place, t) for t in part.column(1).to_pylist()))
                cols = [part.column(0), part.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "y", "at", "n"])

        rows = sample.mapInArrow(sparse, "doc_id long, y int, at array<int>, n array<int>").toPandas().sort_values("doc_id")
    y, at, n = rows["y"].to_numpy(int), [np.asarray(a, int) for a in rows["at"]], [np.asarray(c, int) for c in rows["n"]]
    model = _fit(y, at, n, np.array([s >= z for _, s in telling], bool)) if len(set(y)) == 2 else None

    def make():
        def work(ids, texts):
            severity, p, grade = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int32)
            if model:
                found = [counted(place, t) for t in texts]
                above = model.above(np.array([model.w[a] @ np.log1p(c) if a else 0.0 for a, c in found]))
                severity, p, grade = above.sum(axis=1), above[:, 0], (above >= 0.5).sum(axis=1).astype(np.int32)
            return [pa.array(ids, pa.int64()), pa.array(severity), pa.array(grade), pa.array(p)]

        return work

    out = map_texts(texts, make, "doc_id long, expected_severity double, grade int, p_toxic double", ["doc_id", "expected_severity", "grade", "p_toxic"])
    return out.withColumn("toxic", F.col("p_toxic") >= threshold if model else F.lit(False))


def grades_of(y: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """0 for clean rows, for toxic ones 1 to 3 by thirds of their hits."""
    cuts = np.quantile(hits[y == 1], [1 / 3, 2 / 3])
    return np.where(y == 1, 1 + (hits > cuts[0]).astype(int) + (hits > cuts[1]), 0)


def _fit(y: np.ndarray, at: list[np.ndarray], n: list[np.ndarray], tells: np.ndarray) -> OrdinalRegression:
    grade = grades_of(y, np.array([c[tells[a]].sum() for a, c in zip(at, n)]))
    rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
    return OrdinalRegression(4).fit(rows, np.concatenate(at), np.log1p(np.concatenate(n)), len(at), len(tells), grade)

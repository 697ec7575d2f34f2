"""Language-model, quality and toxicity scores."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from chronoweave.llm.lattice_lm import Lattice, score_texts, words_of
from chronoweave.llm.quality import Network, Space, score_quality
from chronoweave.llm.toxicity import OrdinalRegression, score_toxicity

PIECES = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return Lattice(PIECES)


def by_hand(lattice, word):
    """All segmentations of a word, one after another."""
    chars = [0x110000, *map(ord, word)]
    known = dict(zip(lattice.hashes.tolist(), lattice.ids.tolist()))

    def weight(part):
        h = 0
        for code in part:
            h = lattice.extend(h, code)
        i = known.get(h, -1)
        if i >= 0:
            return math.exp(lattice.weights[i])
        if len(part) == 1 and part[0] != 0x110000:
            return math.exp(sum(lattice.weights[lattice.byte_id[b]] for b in chr(part[0]).encode()))
        return 0.0

    def total(at):
        if at == len(chars):
            return math.exp(lattice.weights[-1])
        return sum(weight(chars[at:to]) * total(to) for to in range(at + 1, len(chars) + 1))

    return math.log(total(0))


@pytest.mark.parametrize("word", ["the", "nation", "é漢x", "a▁b", "😀"])
def test_marginal_equals_the_sum_over_segmentations(lattice, word):
    assert lattice.run([word], lattice.weights)[0] == pytest.approx(by_hand(lattice, word), rel=1e-9)


def test_expected_counts_are_consistent(lattice):
    counts = np.zeros(lattice.n + 1)
    lattice.run(["nation", "the"], lattice.weights, counts)
    assert counts[-1] == 2 and counts[:-1][lattice.begins].sum() == pytest.approx(2)


def test_scores_against_brute_force(spark, lattice):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["The", "of", "Haus", "x" * 40, f"w{rng.randrange(50)}"]) for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, "", "\n"]
    d = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, base_score double")
    out = {h: {r["doc_id"]: r for r in score_texts(d, PIECES, head=h).collect()} for h in (0, 5, 1000)}
    c, ends = Counter(), 0
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(words_of(t or ""))
            ends += 1
    total, types = sum(c.values()) + ends, len(c) + 1
    for i, t in enumerate(texts):
        words = words_of(t or "")
        base = sum(math.log10((n + 0.5) / (total + 0.5 * (types + 1))) for n in [*(c[w] for w in words), ends])
        for got in out.values():
            r = got[i]
            assert r["base_score"] == pytest.approx(base) and r["n_tokens"] == len(words) + 1 and r["train_tokens"] == total
            assert r["n_known"] == sum(w in c for w in words) + 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
            assert r["score"] == pytest.approx(out[0][i]["score"]) and math.isfinite(r["score"])
    assert score_texts(d.limit(0), PIECES).count() == 0


def test_no_rows_to_learn_from_and_odd_ids(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    out = score_texts(spark.createDataFrame([(i, "hello world") for i in held], "doc_id long, text string"), PIECES).collect()
    assert [r["base_score"] for r in out] == [0.0] * 3 and {r["train_tokens"] for r in out} == {0} and {r["n_known"] for r in out} == {0}
    assert all(r["held_out"] and r["n_tokens"] == 3 and r["score"] < 0 for r in out)
    learnt = next(i for i in range(40) if i not in held and zlib.crc32(str(i).encode()) % 5 != 1)
    rows = [(learnt, "a b a"), (learnt, "a b a"), (learnt, "c"), (None, "a c d"), (None, "a c d"), (None, None)]
    got = [r.asDict() for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()]
    assert len(got) == 6 and {r["train_tokens"] for r in got} == {7 + 3}  # rows without an id aren't learnt from
    c, floor = Counter({"a": 4, "b": 2, "c": 1}), 10 + 0.5 * (4 + 1)
    for words, ids in ((["a", "b", "a"], learnt), (["a", "c", "d"], None), ([], None)):
        base = sum(math.log10((n + 0.5) / floor) for n in [*(c[w] for w in words), 3])
        mine = [r for r in got if r["doc_id"] == ids and r["n_tokens"] == len(words) + 1]
        assert mine and all(r["base_score"] == pytest.approx(base) for r in mine)


def test_ordinal_regression_orders_its_grades():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 4, 400)
    model = OrdinalRegression(4).fit(np.arange(400), np.zeros(400, int), y + rng.normal(0, 0.3, 400), 400, 1, y)
    assert (np.diff(model.thresholds()) > 0).all()
    severity = model.above(model.w[0] * np.arange(4.0)).sum(axis=1)
    assert (np.diff(severity) > 0.4).all()


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 5))
    p = 1 / (1 + np.exp(-3 * x[:, 0]))
    y = (rng.random(2000) < p).astype(float)
    got = Network(8, 20).fit(x, y).probability(x)
    assert np.abs(got - p).mean() < 0.1 and ((got > 0.5) == (p > 0.5)).mean() > 0.9


def corpus(spark, n=400):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["th", "er", "on", "ti", "an"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(10, 60))]
        bad, junk = i % 5 == 0, i % 3 == 0
        if bad:
            words[3:3] = [rng.choice(["idiot", "scum", "trash"]) for _ in range(rng.randint(1, 4))]
        docs.append((i, " ".join(w + "%%%" if junk else w for w in words), "a"))
        labels.append((i, int(not junk), int(bad)))
    docs += [(n, None, "b"), (n + 1, "", "b")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_of_held_out_rows(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r for r in score_quality(docs, labels, space=Space(1 << 10, 16)).collect()}
    assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == (i % 3 != 0) for i in held]) > 0.95
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(400))
    assert score_quality(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in score_quality(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_toxic_rows_are_caught_and_clean_ones_left(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r for r in score_toxicity(docs, labels, least=3).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["toxic"] for i in held if i % 5 == 0]) > 0.9
    assert np.mean([got[i]["toxic"] for i in held if i % 5]) < 0.03
    assert all(0 <= r["expected_severity"] <= 3 for r in got.values()) and not got[400]["toxic"]
    assert not any(r["toxic"] for r in score_toxicity(docs.limit(3), labels.limit(0)).collect())
    assert score_toxicity(docs.limit(0), labels).count() == 0

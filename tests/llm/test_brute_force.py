"""Scores and fingerprints worked out again in plain Python, one text and one word at a time."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import blake2b

import numpy as np
import public_tokenizers as P
import pytest

from chronoweave.llm.hashing import constants
from chronoweave.llm.lattice_lm import LONG, Lattice, score_texts
from chronoweave.llm.quality import SHAPES, Network, Space, _shape, score_quality
from chronoweave.llm.simhash import compare_with_next
from chronoweave.llm.toxicity import OrdinalRegression, score_toxicity

PIECES = P.path("piece_bpe_32k.model")
FULL = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & FULL
    return x ^ (x >> 31)


def fingerprint(text):
    """256 votes of the words and pairs of words."""
    codes = [int.from_bytes(blake2b(w, digest_size=8, key=b"chronoweave").digest(), "little") for w in text.encode().lower().split()]
    terms = Counter(codes + [mixed((a * 0x9E3779B97F4A7C15 + b) & FULL) for a, b in zip(codes, codes[1:])])
    out = ""
    for lane in constants(4, 21).tolist():
        votes = [0.0] * 64
        for term, n in terms.items():
            raw = mixed(term ^ lane).to_bytes(8, "little")
            for k in range(64):
                votes[k] += n**0.25 * (1 if raw[k // 8] >> (7 - k % 8) & 1 else -1)
        out += f"{int(''.join('1' if v > 1e-3 else '0' for v in votes), 2):016x}"
    return out


def test_fingerprints_equal_votes_one_by_one(spark):
    rng = random.Random(1)
    texts = [" ".join(f"t{rng.randrange(60)}" for _ in range(rng.randint(0, 60))) for _ in range(12)] + ["", None, "é A a"]
    data = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(5, texts[6])]
    d = spark.createDataFrame(data, "doc_id long, text string")
    share = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 256
    got = compare_with_next(d).collect()
    assert len(got) == len(data)
    known = {t or "": fingerprint(t or "") for _, t in data}
    assert sorted(r["fingerprint"] for r in got) == sorted(known[t or ""] for _, t in data)
    once = {r["doc_id"]: r for r in got if r["doc_id"] not in (5, None)}
    for i in (14, 12, 9, 8):  # whose next is the id below
        t, n = texts[i] or "", texts[i - 1] or ""
        edited = fingerprint(t[: len(t) - len(t) // 2] + n[: len(t) // 2])
        assert once[i]["edited_fingerprint"] == edited
        assert once[i]["near_edited"] == pytest.approx(share(known[t], edited)) and once[i]["near_next"] == pytest.approx(share(known[t], known[n]))


def segmentations(lattice, word):
    """Every segmentation of a word as a list of pieces' ids."""
    known = {h: i for h, i in lattice.starts.items() if i >= 0}
    codes = [0x110000, *map(ord, word)]

    def ids(part):
        h = 0
        for c in part:
            h = lattice.extend(h, c)
        return [known[h]] if h in known else lattice.byte_id[list(chr(part[0]).encode())].tolist() if len(part) == 1 and part[0] != 0x110000 else None

    def rest(at):
        if at == len(codes):
            yield []
        for to in range(at + 1, len(codes) + 1):
            if (x := ids(codes[at:to])) is not None:
                yield from (x + more for more in rest(to))

    return list(rest(0))


def test_scores_of_documents_equal_all_segmentations(spark):
    lattice = Lattice(PIECES)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "Haus", "né", "x漢", f"w{rng.randrange(9)}"]) for _ in range(rng.randint(0, 9))) for _ in range(25)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_texts(d, PIECES, head=3).collect()}
    split = [t.lower().split() for t in texts]
    learnt = [w for i, words in enumerate(split) if zlib.crc32(str(i).encode()) % 5 != 1 for w in words]
    c, ends = Counter(learnt), sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts)))
    total = len(learnt) + ends
    every = {w: segmentations(lattice, w) for words in split for w in words}
    own = np.exp(lattice.weights)
    weigh = lambda p, w: [math.prod(p[i] for i in s) * p[-1] for s in every[w]]
    counts = lattice.counts(1e5)
    for w in c:  # one round of expectation maximisation
        share = np.array(weigh(own, w)) / sum(weigh(own, w))
        for x, s in zip(share, every[w]):
            for i in s:
                counts[i] += x
        counts[-1] += 1
    p = np.exp(lattice.normal(counts[:-1], float(counts[-1])))
    seen = 1 - max(sum(n == 1 for n in c.values()), 1) / total
    for i, words in enumerate(split):
        plain = sum(math.log10(sum(weigh(own, w))) for w in words)
        score = sum(math.log10(seen * c[w] / total + (1 - seen) * sum(weigh(p, w))) for w in words) + math.log10(seen * ends / total)
        assert got[i]["lattice_score"] == pytest.approx(plain, rel=1e-9) and got[i]["score"] == pytest.approx(score, rel=1e-9)


def test_very_long_words_equal_the_same_recursion():
    lattice = Lattice(PIECES)
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefé漢th") for _ in range(LONG + 40))
    both = np.stack([lattice.weights, lattice.weights - 0.1])
    assert lattice._alone(word, lattice.weights, None) == pytest.approx(lattice._length([word], len(word), both, None)[0, 0], rel=1e-9)
    one, two = np.zeros(lattice.n + 1), np.zeros(lattice.n + 1)
    lattice._alone(word, lattice.weights, one)
    lattice._length([word], len(word), both[:1], two)
    assert np.allclose(one, two) and np.isfinite(lattice.run(["q" * 300_000], lattice.weights)).all()


def marked(n=300):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["th", "er", "on"]) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(5, 30))]
        words += [rng.choice(["idiot", "scum"]) for _ in range(rng.randint(1, 4))] if i % 4 == 0 else []
        docs.append((i if i != 7 else None, " ".join(w + "%%" if i % 3 == 0 else w for w in words)))
        labels += [(i, int(i % 3 > 0), int(i % 4 == 0))] * (1 + (i == 9))
    return docs + [(11, "idiot scum"), (n, None)], labels


def learns(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 != 2


def test_toxicity_equals_a_dense_fit(spark):
    docs, labels = marked()
    got = score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    by_id = defaultdict(list)
    for i, _, y in labels:
        by_id[i].append(y)
    rows = sorted(((i, words(t), y) for i, t in docs if learns(i) for y in by_id[i]), key=lambda r: r[0])
    y = np.array([r[2] for r in rows])
    stats = {}
    for w in set().union(*(r[1] for r in rows)):
        bad, good = (sum(w in r[1] for r in rows if r[2] == k) for k in (1, 0))
        n, m = (y == 1).sum(), (y == 0).sum()
        z = (math.log((bad + 0.5) / (n - bad + 0.5)) - math.log((good + 0.5) / (m - good + 0.5))) / math.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
        if bad + good >= 5 and abs(z) >= 2:
            stats[w] = z
    names = sorted(stats)
    dense = lambda ws: np.array([math.log1p(ws.count(w)) for w in names])
    hits = np.array([sum(r[1].count(w) for w in names if stats[w] >= 3) for r in rows])
    cuts = np.quantile(hits[y == 1], [1 / 3, 2 / 3])
    grade = np.array([0 if not b else 1 + (h > cuts[0]) + (h > cuts[1]) for b, h in zip(y, hits)])
    x = np.array([dense(r[1]) for r in rows])
    model = OrdinalRegression(4).fit(np.repeat(np.arange(len(x)), len(names)), np.tile(np.arange(len(names)), len(x)), x.ravel(), len(x), len(names), grade)
    want = sorted((str(i), float(model.above(np.array([dense(words(t)) @ model.w])).sum())) for i, t in docs)
    for (i, a), (j, b) in zip(want, sorted((str(r["doc_id"]), r["expected_severity"]) for r in got)):
        assert i == j and a == pytest.approx(b, abs=1e-6)


def test_quality_equals_plain_pooling(spark):
    docs, labels = marked()
    space = Space(1 << 8, 16)
    got = score_quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), space=space).collect()
    terms = lambda t: re.findall(r"[^\W_]+|[^\w\s]+|_+", t or "")
    bucket = lambda w: zlib.crc32(w.lower().encode()) % space.buckets
    index = space.index_vectors().astype(float)
    vectors = np.zeros((space.buckets, space.dim))
    for _, t in docs:
        b = [bucket(w) for w in terms(t)]
        for k, w in enumerate(b):
            for j in range(max(0, k - 2), min(len(b), k + 3)):
                if j != k:
                    vectors[w] += index[b[j]]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    table = np.concatenate([np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0), index], axis=1)

    def features(t):
        ws, out = terms(t), np.zeros(2 * space.dim + SHAPES + 1)
        for w in ws:
            out[: 2 * space.dim] += table[bucket(w)] / len(ws)
            out[2 * space.dim + _shape(w)] += 1 / len(ws)
        out[-1] = bool(ws)
        return out

    by_id = defaultdict(list)
    for i, q, _ in labels:
        by_id[i].append(q)
    rows = sorted(((i, features(t), q) for i, t in docs if learns(i) for q in by_id[i]), key=lambda r: r[0])
    model = Network().fit(np.array([r[1] for r in rows]), np.array([float(r[2]) for r in rows]))
    want = sorted((str(i), float(model.probability(features(t)[None])[0])) for i, t in docs)
    apart = [abs(a - b) for (_, a), (_, b) in zip(want, sorted((str(r["doc_id"]), r["score"]) for r in got))]
    assert len(apart) == len(docs) and np.median(apart) < 1e-3 and max(apart) < 0.05  # the operator pools in single precision

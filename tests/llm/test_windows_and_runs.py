"""Repeated word windows and periodic runs against plain searches."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from chronoweave.llm import repetitions, window_dedup
from chronoweave.llm.hashing import word_codes
from chronoweave.llm.repetitions import SquareCatcher, periodic_runs, word_runs
from chronoweave.llm.window_dedup import WindowHasher, remove_repeated_windows

LAST = 2**63 - 1


def plain_windows(rows, size):
    words = [(text or "").encode().split() for _, text in rows]
    ids = [LAST if i is None else i for i, _ in rows]
    low = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            low[key] = min(i, low.get(key, i))
    out = []
    for (doc_id, _), i, w in zip(rows, ids, words):
        gone = set()
        for k in range(len(w) - size + 1):
            if low[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def corpus(rng, n):
    vocabulary = ["la", "de", "Ärger", "the", "x", "The", "of it", "zu"]
    rows, shared = [], [[rng.choice(vocabulary) for _ in range(30)] for _ in range(6)]
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"{rng.choice(vocabulary)}{rng.randrange(9)}" for _ in range(rng.randint(0, 25))]
            part = rng.choice(shared)
            at = rng.randint(0, 12)
            words += part[at : at + rng.randint(5, 30)]
        rows.append((rng.choice([i, i, i, i // 2, None]), rng.choice([" ", "\n", " \t "]).join(words) if rng.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_windows_of_random_texts(spark, monkeypatch, block):
    rng = random.Random(block)
    rows = corpus(rng, 300)
    rows += rows[:20]
    monkeypatch.setattr(window_dedup, "BLOCK", block)
    got = [tuple(r) for r in remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    want = plain_windows(rows, 13)
    assert sorted(got, key=str) == sorted(want, key=str) and any(0 < r[2] < r[1] for r in want)


def test_packs_don_t_depend_on_blocks(monkeypatch):
    rng = random.Random(1)
    texts = [[b"%d" % rng.randrange(5) for _ in range(n)] for n in (3, 500, 12, 13, 0, 14, 200)]
    seen = []
    for block in (1 << 20, 64):
        monkeypatch.setattr(window_dedup, "BLOCK", block)
        names = {}
        for text, start, n, name, _ in WindowHasher(13).packs_in_blocks(texts):
            for t, s, k, h in zip(text.tolist(), start.tolist(), n.tolist(), name.tolist()):
                assert 0 < k < 16
                for i in range(k):
                    assert (t, s + i) not in names
                    names[t, s + i] = h
        seen.append(names)
    assert seen[0] == seen[1] and len(seen[0]) == sum(max(0, len(t) - 12) for t in texts)


def test_word_codes_are_those_of_the_words():
    rng = random.Random(8)
    texts = [b"", b" ", b"\t\n", b"a a\0 a\0\0 \0", b"  x \x0b\x0cy\r", b" ".join(b"a" * n for n in range(1, 130)), b"b" * 64 + b" " + b"b" * 65, b""]
    texts += [bytes(rng.choice(b"ab \t\xc3") for _ in range(rng.randrange(200))) for _ in range(100)]
    codes, lengths = word_codes(texts)
    words = [t.split() for t in texts]
    assert lengths.tolist() == [len(w) for w in words]
    pairs = set(zip((x for w in words for x in w), codes.tolist(), strict=True))
    assert len(pairs) == len({x for x, _ in pairs}) == len({c for _, c in pairs})
    assert [len(x) for x in word_codes([])] == [0, 0]


def test_odd_windows(spark):
    text = " ".join(str(i) for i in range(40))
    rows = [(5, text), (5, text), (7, text), (None, text), (None, text + " more"), (3, ""), (4, None), (9, " \n"), (11, "a b"), (12, text.replace(" ", " "))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, twin int, packs string")
    got = [tuple(r) for r in remove_repeated_windows(df).collect()]
    assert sorted(got, key=str) == sorted(plain_windows(rows, 13), key=str)
    assert remove_repeated_windows(df.limit(0)).count() == 0
    full = {r["doc_id"]: r for r in remove_repeated_windows(df, with_text=True).where("doc_id in (5, 7)").collect()}
    assert full[7]["spans"] == [[0, 40]] and full[7]["kept_text"] == "" and full[5]["kept_text"] == text


def test_very_many_copies_and_kinds_of_one_line(spark):
    line = " ".join(f"l{i}" for i in range(20))
    rows = [(i, f"a{i} b{i} {line} c{i % 7} d{i}") for i in range(3000)]
    got = sorted(tuple(r) for r in remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_windows(rows, 13)


def plain_runs(x, least=12):
    n, found = len(x), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i - s >= max(q, least - q):
                found.setdefault((s, i + q), q)
            i = max(i, s + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def some_numbers(rng):
    k = rng.choice([1, 2, 2, 3, 4])
    x = [rng.randrange(k) for _ in range(rng.randint(0, 160))]
    for _ in range(rng.randint(0, 3)):
        p = rng.randint(1, 30)
        part = [rng.randrange(9) for _ in range(p)] * rng.randint(2, 6)
        at = rng.randint(0, len(x))
        x[at:at] = part[: rng.randint(1, len(part))]
    return x


def test_runs_as_numbers_are_appended():
    rng = random.Random(1)
    for trial in range(1500):
        x = some_numbers(rng)
        whole, parts, at = SquareCatcher(), SquareCatcher(), 0
        whole.append(np.array(x, np.int64))
        while at < len(x):
            step = rng.randint(1, 40)
            parts.append(np.array(x[at : at + step], np.int64))
            at += step
            if trial < 150:
                assert parts.runs() == plain_runs(x[:at])
        assert whole.runs() == parts.runs() == plain_runs(x)


def test_runs_where_sums_collide():
    x = [bin(i).count("1") & 1 for i in range(1 << 13)]  # equal sums of unequal words modulo 2^64
    catcher = SquareCatcher()
    catcher.append(np.array(x, np.int64))
    got = catcher.runs()
    assert got == plain_runs_fast(x)


def plain_runs_fast(x, least=12):
    x, found = np.array(x), {}
    for q in range(1, len(x)):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]]).view(np.int8)
        edge = np.flatnonzero(np.diff(same))
        for s, t in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if t - s >= max(q, least - q):
                found.setdefault((s, t + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_long_runs_stay_small():
    catcher = SquareCatcher()
    for _ in range(20):
        catcher.append(np.zeros(20_000, np.int64))
    assert catcher.runs() == [(0, 400_000, 1)] and len(catcher.open) < 10
    fibonacci, longer = [0], [0, 1]
    while len(longer) < 20_000:
        fibonacci, longer = longer, longer + fibonacci
    catcher = SquareCatcher()
    catcher.append(np.array(longer, np.int64))
    assert catcher.runs() == plain_runs_fast(longer)


def test_chunks_of_words(monkeypatch):
    rng = random.Random(3)
    for _ in range(50):
        words = [b"%d" % i for i in some_numbers(rng)]
        assert word_runs(words) == word_runs(words, chunk=7) == plain_runs(words)


def plain_digest(doc_id, text, edited):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if edited and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    top = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None, None, None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = [hashlib.sha256(x).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs).encode(), b" ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *top, top[1] * 1000 // top[2] if runs else None, *digest)


def test_runs_of_texts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{k}" for k in some_numbers(rng))) for i in range(200)]
    rows += [(None, "a " * 30), (7, "a b " * 10), (7, None), (8, ""), (8, "\n\t"), (9, "x y " * 3000 + "end"), rows[0]]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, n_runs string, start int")
    for edited in (True, False):
        got = [tuple(r) for r in periodic_runs(df, edited=edited).collect()]
        assert sorted(got, key=str) == sorted((plain_digest(*r, edited) for r in rows), key=str)
    assert periodic_runs(df.limit(0)).count() == 0
    full = periodic_runs(df.where("text = '" + "a b " * 10 + "'"), with_text=True).collect()[0]
    assert full["collapsed_text"] == "a b" and [tuple(r) for r in full["runs"]] == [(0, 20, 2)]
    assert repetitions.planted(None, [b"a"] * 5) == [b"a"] * 5

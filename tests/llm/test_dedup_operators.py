"""Near-duplicates and repeats against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import buckets, embedding_dedup, suffix_dedup
from chronoweave.llm.components import connected
from chronoweave.llm.embedding_dedup import near_vectors
from chronoweave.llm.hashing import common_shingles
from chronoweave.llm.lattice import LatticeHash, minimal_vectors, nearest_e8
from chronoweave.llm.minhash import fewest_matches, near_duplicates
from chronoweave.llm.queries import QUERIES
from chronoweave.llm.simhash import SimHash, compare_with_next, fingerprint, near_fingerprints, within_radius
from chronoweave.llm.suffix_array import SuffixArray
from chronoweave.llm.suffix_dedup import SuffixFamily, remove_repeats
from chronoweave.session import materialise

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_copies(n=150, seed=1):
    """A base text with one to four words changed, so that many pairs are about the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out + [" ".join(f"u{seed}_{i}_{j}" for j in range(60)) for i in range(20)]


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("percent, bands, rows", [(85, 32, 8), (80, 40, 6)])  # as op2 and the pipeline have them
def test_near_duplicates_equal_brute_force(spark, percent, bands, rows):
    texts = [*near_copies(), "", "  \n", "A b", "a B", "one two three four five", None]
    texts += texts[:10]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return bool(sets[i]) and 100 * both >= percent * len(sets[i] | sets[j]) and both > 0

    want = components(len(texts), linked)
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, component_id int")
    got = near_duplicates(d, percent=percent, bands=bands, rows=rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in enumerate(sets)}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    d = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (2, "d e f"), (None, "a b c")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in near_duplicates(d).collect())
    assert got[1:] == [(1, 1), (1, 1), (2, 1)]
    assert near_duplicates(d.limit(0)).count() == 0


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_texts_that_share_no_word_stay_apart(spark):
    """Polynomials modulo 2^64 collide on these whatever their base."""
    texts = [t for n in (1024, 2048, 4096) for t in (thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba")))]
    texts += [" ".join([t] * 3 + list("cdefghij")) for t in texts[:2]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(d, percent=85).collect()} == {i: i for i in range(len(texts))}


@pytest.mark.parametrize("seed", range(4))
def test_common_shingles_equal_sets_of_words(seed):
    rng = random.Random(seed)
    for _ in range(50):
        a, b = ([rng.choice([b"x", b"y", b"zz"]) for _ in range(rng.randint(1, 30))] for _ in range(2))
        x, y = ({tuple(s[i : i + 5]) for i in range(max(1, len(s) - 4))} for s in (a, b))
        assert common_shingles(a, b, 5) == (len(x), len(y), len(x & y))


def test_very_long_texts_are_compared_whole(spark):
    words = [f"w{i}" for i in range(60_000)]
    other = [*words[:56_000], *(f"v{i}" for i in range(3_000))]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:40_000])), (4, "x" * 500_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(d, percent=85).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    for k in (32, 64, 128, 256):
        lost = (rng.binomial(k, 0.85, 200_000) < fewest_matches(k, 0.85, 1e-6)).mean()
        assert lost < 1e-4
        assert fewest_matches(k, 0.85, 1e-6) > 0.4 * k


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def repeated(texts, length):
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("alike, shard, ids", [(1, 1 << 20, 0), (4096, 1 << 20, 1_000_000), (40, 2000, 1_000_000)])
def test_repeats_equal_brute_force(spark, alike, shard, ids, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ALIKE", alike)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", ids)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 80))) for _ in range(60)]
    for _ in range(60):  # passages that many texts share, at odd places
        a, b = rng.choice(texts), rng.randrange(60)
        at, cut = rng.randrange(len(a) + 1), rng.randrange(len(texts[b]) + 1)
        texts[b] = texts[b][:cut] + a[at : at + rng.randint(20, 120)] + texts[b][cut:]
    texts += ["a" * 150, "ab" * 90, "", texts[0]]
    want = repeated([t.encode() for t in texts], 50)
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*texts, None])], "doc_id long, text string, spans string")
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(d, length=50, gram=16).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert got[len(texts)][:3] == (0, 0, 0)
    assert remove_repeats(d.limit(0), length=50, gram=16).count() == 0


def test_only_what_can_match_goes_to_the_family(spark, monkeypatch):
    rng = random.Random(13)
    noise = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    phrase, passage = noise(150), noise(260)
    texts = [noise(300) + phrase + noise(300) for _ in range(20)] + [noise(300) + passage + noise(300) for _ in range(2)]
    sizes, add = [], suffix_dedup.SuffixFamily.add

    def counted(self, batch):
        sizes.extend(len(r["bytes"]) - self.length + 1 for r in batch.collect())
        add(self, batch)

    monkeypatch.setattr(suffix_dedup.SuffixFamily, "add", counted)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(d).collect()}
    assert [got[i] for i in range(len(texts))] == repeated([t.encode() for t in texts], 200)
    assert 0 < sum(sizes) < 1000  # none of the thousands of strings that start alike within the phrase


def test_kept_texts_are_what_is_left(spark):
    p = "".join(chr(97 + i % 26) + str(i) for i in range(40))
    d = spark.createDataFrame([(1, "x1" + p), (2, "y2" + p + "z"), (3, "q")], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept_text"], r["spans"]) for r in remove_repeats(d, length=50, gram=16, with_text=True).collect()}
    assert got == {1: ("x1", [[2, 2 + len(p)]]), 2: ("y2z", [[2, 2 + len(p)]]), 3: ("q", [])}


def test_repeats_of_200_bytes_with_null_and_repeated_ids(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghij klmnop\n") for _ in range(n))
    p, hot = noise(700), noise(260)
    data = [(1, "x" * 10 + p), (1, noise(17) + "z" * 400), (2, p + noise(90)), (None, noise(40) + p[100:450] + noise(30)), (None, noise(900)), (3, None)]
    data += [(4, noise(rng.randint(0, 300)) + hot[rng.randint(0, 80) :] + noise(rng.randint(0, 300))) for _ in range(40)]
    long = noise(1_300_000)
    data += [(5, long), (6, noise(50) + long[1_048_300:1_048_900] + noise(20)), (7, p), (7, p)]
    want = repeated([(t or "").encode() for _, t in data], 200)
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = remove_repeats(d).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got)) == sorted(key((i, *w)) for (i, _), w in zip(data, want))


def test_suffix_arrays_are_in_byte_order():
    rng = random.Random(7)
    for length in (3, 8, 20):
        make = lambda n: [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 60))) for _ in range(n)]
        sides = [make(12), make(7)]
        one, two = (SuffixArray.build(s, np.arange(len(s)), np.zeros(len(s), int), length) for s in sides)
        both = one.merge(two)
        strings = sorted(s[i : i + length] for side in sides for s in side for i in range(len(s) - length + 1))
        of = lambda a: [a.text[p : p + length].tobytes() for p in a.order]
        assert of(both) == strings and len(of(one)) + len(of(two)) == len(strings)
        common = lambda x, y: next((k for k in range(length) if x[k] != y[k]), length)
        assert both.shared.tolist()[1:] == [common(x, y) for x, y in zip(strings, strings[1:])]
        times = Counter(strings)
        assert both.repeated()[both.order].tolist() == [times[s] > 1 for s in strings]


def test_levels_grow_geometrically(spark):
    family = SuffixFamily(20, 2)
    rng = random.Random(8)
    data = [(n % 5, n, 0, bytes(rng.choice(b"abcd") for _ in range(60))) for n in range(49)] + [(4, 49, 7, b"x" + bytes(9) * 3)]
    data.append((4, 50, 3, data[4][3][10:40]))
    d = spark.createDataFrame(data, "name long, row long, start long, bytes binary")
    for i in range(6):
        family.add(d.where(F.col("row") % 6 == i))
    assert [n for n, _ in family.levels] == [4, 1, 1] and len(family.matched) == 1 + 2 + 2 + 3 + 2 + 3
    assert sorted(tuple(r) for r in family.matches().distinct().collect()) == [(4, 10, 40), (49, 8, 35), (50, 3, 33)]


def test_e8_points_are_nearest():
    x = np.random.default_rng(2).standard_normal((200, 8)) * 2
    e = nearest_e8(x)
    v = minimal_vectors()
    assert len({tuple(r) for r in v}) == 240 and np.allclose((v**2).sum(axis=1), 2)
    d = ((x - e) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()
    assert (((x[:, None] - e[:, None] - v[None]) ** 2).sum(axis=2) >= d[:, None] - 1e-9).all()


def vector_links(vectors, cosine=0.95):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("block, side", [(512, 1024), (16, 2)])
def test_near_vectors_equal_brute_force(spark, block, side, monkeypatch):
    """Clusters, a chain that winds through many directions, copies, and vectors of another length."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "SIDE", side)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((460, 64))
    x[:120] = x[0] + rng.standard_normal((120, 64)) * rng.uniform(0.05, 0.22, (120, 1))
    x[130] = x[129]
    for i in range(200, 400):  # steps of 8 degrees
        step = rng.standard_normal(64)
        last = x[i - 1] / np.linalg.norm(x[i - 1])
        step -= (step @ last) * last
        x[i] = np.cos(np.radians(8)) * last + np.sin(np.radians(8)) * step / np.linalg.norm(step)
    x = x.astype(np.float32).astype(np.float64)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0, None], []]
    data += [(900 + i, v) for i, v in enumerate(odd)] + [(950, [1.0, 2.0]), (951, [2.0, 4.0]), (952, [-2.0, 1.0]), (None, data[0][1])]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id")
    near = vector_links(x)
    want = components(len(x), lambda i, j: near[i, j])
    got = {r["vec_id"]: r for r in near_vectors(d).collect()}
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in range(len(x))} == {i: (near[i].sum(), want[i]) for i in range(len(x))}
    assert len(set(want[200:400])) == 1 and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (950, 951, 952)] == [(1, 950), (1, 950), (0, 952)]
    assert (got[None]["n_links"], got[None]["component_id"]) == (0, None)
    assert near_vectors(d.limit(0)).count() == 0


def test_rows_that_share_a_vector_id(spark):
    data = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0])]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(d).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4)]


@pytest.mark.parametrize("dim, cosine, least", [(64, 0.9505, 0.99), (384, 0.9505, 0.99), (64, 0.97, 0.999), (64, 0.99, 0.9999)])
def test_planted_pairs_share_a_cell(dim, cosine, least):
    rng = np.random.default_rng(9)
    a, step = rng.standard_normal((2, 4000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    step -= (step * a).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * step / np.linalg.norm(step, axis=1, keepdims=True)
    hasher = LatticeHash(dim, 10, 2, 0.7, 4)
    recall = np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(hasher.keys(a), hasher.keys(b))])
    assert recall >= least


def test_fingerprints_and_edits(spark):
    rng = random.Random(4)
    texts = [" ".join(f"t{rng.randrange(3000)}" for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["é", "", None]
    texts[5] = texts[4]
    d = spark.createDataFrame([(3 * i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, head int")
    for ranges in (1, 7, 500):
        got = {r["doc_id"]: r for r in compare_with_next(d, ranges=ranges).collect()}
        ids = sorted(got, reverse=True)
        assert len(got) == len(texts)
        for i, k in enumerate(ids):
            t, n = texts[k // 3] or "", texts[ids[(i + 1) % len(ids)] // 3] or ""
            edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[k]["n_chars"] == len(t)
    assert got[12]["fingerprint"] == got[15]["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.08
    assert compare_with_next(d.limit(0)).count() == 0 and compare_with_next(d.limit(1)).count() == 1


def test_block_tables_find_all_within_the_radius(spark):
    texts = near_copies(60, 7)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = SimHash(64).fingerprints(texts)
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    want = components(len(texts), lambda i, j: apart[i, j] <= 5)
    for together in (1, 2, 3):
        got = {r["doc_id"]: r["component_id"] for r in within_radius(fingerprint(d, 64), 5, 64, together).collect()}
        assert got == dict(enumerate(want))


def test_near_fingerprints_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(2000))
    rows = [(0, None), (1, ""), (2, base), (3, base + " end"), (3, base), (None, base), (None, "alone here"), (4, "other words " * 50), (5, "\t \n")]
    rows += [(10 + i, base) for i in range(30)]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fingerprint string, component_id string")
    got = near_fingerprints(d).collect()
    prints = SimHash().fingerprints([t or "" for _, t in rows])
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    root = components(len(rows), lambda i, j: apart[i, j] <= 7)
    least = {}
    for (doc, _), c in zip(rows, root):
        least[c] = min((v for v in (doc, least.get(c)) if v is not None), default=None)
    want = [(doc, p.tobytes().hex(), least[c]) for (doc, _), p, c in zip(rows, prints, root)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert near_fingerprints(d.limit(0)).collect() == []


def test_registered_fingerprint_groups(spark):
    """The registered radius and bits against all pairs, on a whole table; unlike fingerprints are linked too."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = SimHash().fingerprints([r["text"] or "" for r in rows])
    words = prints.view(np.uint64)
    near = [set(np.flatnonzero(np.bitwise_count(words ^ w).sum(axis=1) <= 16).tolist()) for w in words]
    assert any((words[i] != words[j]).any() for i, others in enumerate(near) for j in others)
    root = components(len(rows), lambda i, j: j in near[i])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["fingerprint_groups"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {r["doc_id"]: (p.tobytes().hex(), rows[c]["doc_id"]) for r, p, c in zip(rows, prints, root)}


def test_multiplied_rows_of_buckets_are_never_broadcast(spark, monkeypatch):
    """Spark takes an id's rows in many tables for one row; at 0.1 GB it broadcast those of fingerprint_groups from a driver of 1 GB."""
    plans = {}

    def written(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, name)

    def tables(batches):
        for b in batches:
            ids = np.repeat(b.column(0).to_numpy(), 40)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(40), b.num_rows))], names=["id", "key"])

    class Even:
        def __init__(self, table):
            self.ids = table["id"].to_numpy()

        def likely(self, a, b):
            return [(i, j) for i in a.tolist() for j in b.tolist() if self.ids[i] % 2 == self.ids[j] % 2 == 0]

        def same(self, i, j):
            return i != j

    monkeypatch.setattr(buckets, "materialise", written)
    ids = spark.range(1, 31).select("id")
    banded = ids.mapInArrow(tables, "id long, key long")
    links_of = lambda pairs: materialise(pairs.where("a % 2 = 0 and b % 2 = 0").selectExpr("a AS u", "b AS v"), "verified")
    found = buckets.bucket_components(banded, links_of, lambda ids: ids, Even)
    assert {(r["id"], r["component"]) for r in found.collect()} == {(i, 2) for i in range(2, 31, 2)}
    for name in ("buckets", "open", "tiles"):
        assert plans[name] and not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in plans[name]), name

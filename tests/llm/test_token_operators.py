"""Token counts, piece codec and packing against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from chronoweave.llm import packing
from chronoweave.llm.packing import ByteWords, best_fit_plan, pack_documents, place, sequences, token_pieces
from chronoweave.llm.piece_codec import ChunkTable, encode_pieces
from chronoweave.llm.token_counts import PieceCounter, count_tokens

PIECES, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")


def odd_texts(n=200, seed=1):
    rng = random.Random(seed)
    alphabet = " ab\n▁é漢\t😀eth12,.  's\x1c\x85　"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 700))) for _ in range(n)]
    return [*made, "", " ", "  ", "a", " a ", "▁" * 300, " " * 900, "e" * 2000 + " " + "th" * 400, "<|endoftext|> a", "<s>x</s><unk>"]


def rows(spark, texts):
    data = [(i, t, f"x{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, row string")


@pytest.mark.parametrize("chunk, overlap", [(64, 2), (200, 8), (16384, 128)])
def test_counts_equal_the_library(chunk, overlap):
    c = PieceCounter(PIECES, chunk, overlap, most=500)
    texts = odd_texts()
    assert c.counts(texts) == [len(c.sp.encode(t)) for t in texts]
    if chunk == 64:
        assert c.widened > 0


def test_round_trips_equal_the_library():
    t = ChunkTable(PIECES, most=300)
    texts = odd_texts(seed=2)
    want = [(",".join(map(str, i)), t.sp.decode(i)) for i in map(t.sp.encode, texts)]
    assert t.by_chunk and t.round_trips(texts) == want


def test_byte_words_equal_the_library():
    w = ByteWords(BYTES, most=300)
    texts = odd_texts(seed=3)
    assert w.word is not None
    assert w.encode(texts) == w.raw(texts)


def test_texts_are_encoded_in_stretches_not_word_by_word(monkeypatch):
    w, texts = ByteWords(BYTES), [" ".join(f"wörd{i} {i}\n" for i in range(400)), " lead", "tail ", " ", "", *odd_texts(seed=5)]
    plain, calls, word = texts[0].replace("\n", ";"), [], w.word
    w.word = lambda text: calls.append(text) or word(text)
    assert w.encode([plain]) == w.raw([plain]) and len(calls) == 1
    monkeypatch.setattr(packing, "STRETCH", 7)
    assert w.encode([plain, *texts]) == w.raw([plain, *texts]) and len(calls) > 400
    w.word = None
    assert w.encode([plain, *texts]) == w.raw([plain, *texts])


def test_nulls_repeats_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, None, 5), (1, "a b", 6), (None, "", 7), (2, "a b", 8)], "doc_id long, text string, n_tokens int")
    got = {(r["doc_id"], r["n_tokens"], r["n_bytes"]) for r in count_tokens(d, PIECES).collect()}
    assert got == {(1, 0, 0), (1, 2, 3), (None, 0, 0), (2, 2, 3)}
    assert sorted(r["n_tokens"] for r in encode_pieces(d, PIECES).collect()) == [0, 0, 2, 2]
    packed = pack_documents(d, BYTES, 8).collect()
    assert sorted(r["length"] for r in packed) == [1, 1, 3, 3]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(none, PIECES).count() == encode_pieces(none, PIECES).count() == pack_documents(none, BYTES).count() == 0


def test_pieces_are_cut_from_the_end(spark):
    texts = odd_texts(30, 4)
    d = rows(spark, texts)
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in token_pieces(d, BYTES, 16).collect()}
    want, w = {}, ByteWords(BYTES)
    for i, ids in enumerate(w.raw(texts)):
        ids = np.append(np.frombuffer(ids, "<u4"), 0).astype("<u4")
        first = (len(ids) - 1) % 16 + 1
        cuts = [0, *range(first, len(ids) + 1, 16)]
        want |= {(i, k): (a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert got == want


def fit_one_by_one(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        ok = [i for i, r in enumerate(rooms) if r >= n]
        if ok:
            rooms[min(ok, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_as_good_as_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 400))] + [7] * rng.randint(0, 300)
    hist = {n: lengths.count(n) for n in set(lengths)}
    plan = best_fit_plan(hist, 50)
    assert max(s + k for _, _, _, s, k, _ in plan) == fit_one_by_one(lengths, 50)
    for n, c in hist.items():
        ranks = sorted((r, r + m) for length, r, m, *_ in plan if length == n)
        assert ranks[0][0] == 0 and ranks[-1][1] == c and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:]))


def test_a_hot_length_is_ranked_in_groups_without_gaps(spark):
    d = spark.range(700).selectExpr("id AS doc_id", "0 AS piece", "CASE WHEN id % 3 > 0 THEN 5 ELSE 1 + id % 9 END AS length")
    got = place(d, 16, rank_rows=20).collect()
    assert len(got) == 700
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 16
    assert len(seqs) == fit_one_by_one([r["length"] for r in got], 16)


def test_sequences_hold_the_documents_ids(spark):
    packed = pack_documents(rows(spark, ["a b c", "d e"]), BYTES, 64, with_ids=True)
    s = sequences(packed).collect()
    assert len(s) == 1 and list(s[0]["input_ids"]).count(0) == 2

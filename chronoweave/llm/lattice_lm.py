"""Language-model scores from the lattice of all segmentations of a text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, inf, log1p, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.arrow import slices, with_id_and_text
from chronoweave.llm.hashing import mix
from chronoweave.llm.pieces import MARK, load_model
from chronoweave.llm.samples import fold
from chronoweave.session import materialise

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: Words of more characters are scored one by one.
LONG = 200
_START = 0x110000  # the code of a word's own marker, which no character has


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


class Lattice:
    """All segmentations of marked words into the pieces of an existing vocabulary.

    Weights are natural logarithms: of a piece that begins a word among those, of
    any other piece or the end of the word among these. A character that is no
    piece itself is the product of its bytes' pieces. ``weights`` holds one number a
    piece and, last, the end's.
    """

    def __init__(self, model_path: str):
        sp = load_model(model_path)
        self.n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.n)]
        odd = [sp.is_control(i) or sp.is_unknown(i) for i in range(self.n)]
        byte = [sp.is_byte(i) for i in range(self.n)]
        self.byte_id = np.full(256, -1)
        for i, is_byte in enumerate(byte):
            if is_byte:
                self.byte_id[int(names[i][1:-1], 16)] = i
        self.begins = np.array([p.startswith(MARK) for p in names])
        used = [i for i in range(self.n) if not (odd[i] or byte[i]) and MARK not in names[i][1:]]
        self.usable = np.zeros(self.n, bool)
        self.usable[used] = True
        self.usable[self.byte_id[self.byte_id >= 0]] = True
        self.longest = max(len(names[i]) for i in used)
        # all beginnings of pieces by their hashes, with the piece's id or -1 where it is no piece itself
        starts: dict[int, int] = {}
        for i in used:
            h = 0
            for k, c in enumerate(names[i]):
                h = self.extend(h, _START if k == 0 and c == MARK else ord(c))
                starts.setdefault(h, -1)
            starts[h] = i
        self.starts = starts
        self.hashes = np.array(list(starts), _U)
        self.ids = np.array(list(starts.values()))
        self.tables = self._tables()
        scores = np.array([sp.get_score(i) for i in range(self.n)])
        rank = np.where(scores < -1e6, self.n, -scores)
        self.weights = self.normal(1.0 / (rank + 10.0))

    @staticmethod
    def extend(h: int, code: int) -> int:
        return (h * int(_BASE) + int(mix(np.array([code], _U))[0])) % (1 << 64)

    def _tables(self) -> list[tuple[np.uint64, np.uint64, np.ndarray]]:
        """Places of the hashes by some of their bits; what collides goes to the next, smaller table."""
        out, rest, shift, bits = [], np.arange(len(self.hashes)), 44, 20
        while len(rest):
            slots = ((self.hashes[rest] >> _U(shift)) & _U((1 << bits) - 1)).astype(np.int64)
            _, first = np.unique(slots, return_index=True)
            table = np.full(1 << bits, -1, np.int32)
            table[slots[first]] = rest[first]
            out.append((_U(shift), _U((1 << bits) - 1), table))
            rest, shift, bits = np.delete(rest, first), shift - 12, max(bits - 4, 12)
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """The places of hashes, -1 where they are no beginning of a piece."""
        out = np.full(len(h), -1, np.int64)
        for shift, mask, table in self.tables:
            at = table[((h >> shift) & mask).astype(np.int64)]
            hit = (at >= 0) & (self.hashes[at] == h)
            out[hit] = at[hit]
        return out

    def normal(self, counts: np.ndarray, ends: float | None = None) -> np.ndarray:
        """Weights from counts of pieces and of word ends; at first a fifth of what follows a piece are ends."""
        c = np.where(self.usable, counts, 0.0)
        first, rest = c[self.begins].sum(), c[~self.begins].sum()
        ends = rest / 4 if ends is None else ends
        with np.errstate(divide="ignore"):
            w = np.log(np.where(self.begins, c / first, c / (rest + ends)))
            return np.append(w, np.log(ends / (rest + ends)))

    def counts(self, strength: float) -> np.ndarray:
        """The vocabulary's own weights as counts that add up to about ``strength``: the prior of what is learnt."""
        p = np.exp(self.weights)
        return np.append(np.where(self.usable, p[:-1], 0.0), p[-1]) * strength / 2

    def _arcs(self, words: list[str], length: int):
        """(from, to, rows, piece ids, spelled): the rows whose characters there are a piece, and those whose one
        character is none, with its bytes' ids. A row is followed only as long as a piece can go on."""
        codes = np.concatenate([np.full((len(words), 1), _START, np.int64), _codes(words, length).astype(np.int64)], axis=1)
        named = mix(codes.astype(_U)).T.copy()
        with np.errstate(over="ignore"):
            for at in range(length + 1):
                rows, h = np.arange(len(words)), named[at]
                for to in range(at + 1, min(at + self.longest, length + 1) + 1):
                    if to > at + 1:
                        h = h * _BASE + named[to - 1][rows]
                    place = self.find(h)
                    ids = np.where(place >= 0, self.ids[place], -1)
                    spelled = self._bytes(codes[:, at], ids) if to == at + 1 else []
                    whole = ids >= 0
                    yield at, to, rows[whole], ids[whole], spelled
                    going = place >= 0
                    rows, h = rows[going], h[going]
                    if not len(rows):
                        break

    def _bytes(self, codes: np.ndarray, found: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For rows whose character is no piece: the ids of its bytes."""
        rows = np.flatnonzero((found < 0) & (codes != _START))
        return [(int(r), self.byte_id[list(chr(int(codes[r])).encode("utf-8", "surrogatepass"))]) for r in rows]

    def run(self, words: list[str], weights: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """The log of each word's marginal probability by the forward recursion; adds expected counts if given.

        weights may be several rows, which give as many rows of results.
        """
        each = np.atleast_2d(weights)
        out = np.full((len(each), len(words)), -np.inf)
        lengths = np.array([len(w) for w in words])
        for length in np.unique(lengths[lengths <= LONG]):
            rows = np.flatnonzero(lengths == length)
            for at in range(0, len(rows), 4096):
                some = rows[at : at + 4096]
                out[:, some] = self._length([words[i] for i in some], int(length), each, counts)
        for i in np.flatnonzero(lengths > LONG):
            out[:, i] = [self._alone(words[i], w, counts) for w in each]
        return out.reshape(*weights.shape[:-1], len(words))

    def _length(self, words: list[str], length: int, weights: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
        n, end = length + 1, weights[:, -1:]
        alpha = np.full((n + 1, len(weights), len(words)), -np.inf)
        alpha[0] = 0.0
        kept = []
        for at, to, rows, ids, spelled in self._arcs(words, length):
            if len(rows):
                alpha[to][:, rows] = np.logaddexp(alpha[to][:, rows], alpha[at][:, rows] + weights[:, ids])
            for row, parts in spelled:
                alpha[to, :, row] = np.logaddexp(alpha[to, :, row], alpha[at, :, row] + weights[:, parts].sum(axis=1))
            if counts is not None:
                kept.append((at, to, rows, ids, spelled))
        total = alpha[n] + end
        if counts is not None:
            self._expect(kept, alpha[:, 0], total[0], weights[0], counts)
        return total

    @staticmethod
    def _expect(kept: list, alpha: np.ndarray, total: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> None:
        """Adds the expected counts of pieces and ends: each arc's share of the word's probability."""
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = weights[-1]
        seen_ids, seen_shares = [], []
        with np.errstate(invalid="ignore"):
            # arcs come by where they begin: walked backwards each position is complete before it is used
            for at, to, rows, ids, spelled in reversed(kept):
                if len(rows):
                    after = weights[ids] + beta[to, rows]
                    beta[at, rows] = np.logaddexp(beta[at, rows], after)
                    seen_ids.append(ids)
                    seen_shares.append(np.nan_to_num(np.exp(alpha[at, rows] + after - total[rows])))
                for row, parts in spelled:
                    after = weights[parts].sum() + beta[to, row]
                    beta[at, row] = np.logaddexp(beta[at, row], after)
                    np.add.at(counts, parts, np.nan_to_num(np.exp(alpha[at, row] + after - total[row])))
        if seen_ids:
            counts += np.bincount(np.concatenate(seen_ids), np.concatenate(seen_shares), len(counts))
        counts[-1] += np.isfinite(total).sum()

    def _arcs_at(self, codes: list[int], named: list[int], at: int) -> Iterator[tuple[int, list[int]]]:
        """(to, piece ids) of the pieces of one word that begin at a position."""
        h, found = 0, False
        for to in range(at + 1, min(at + self.longest, len(codes)) + 1):
            h = (h * int(_BASE) + named[to - 1]) % (1 << 64)
            place = self.starts.get(h)
            if place is not None and place >= 0:
                yield to, [place]
            if to == at + 1 and (place is None or place < 0) and codes[at] != _START:
                yield to, self.byte_id[list(chr(codes[at]).encode("utf-8", "surrogatepass"))].tolist()
            if place is None:
                return

    def _alone(self, word: str, weights: np.ndarray, counts: np.ndarray | None) -> float:
        """As _length() for one very long word, position by position: time and memory in proportion to its length."""
        codes = [_START, *map(ord, word)]
        named = mix(np.array(codes, _U)).tolist()
        w = weights.tolist()
        add = lambda x, y: y if x == -inf else x if y == -inf else max(x, y) + log1p(exp(-abs(x - y)))
        alpha = [0.0] + [-inf] * len(codes)
        for at in range(len(codes)):
            for to, ids in self._arcs_at(codes, named, at):
                alpha[to] = add(alpha[to], alpha[at] + sum(w[i] for i in ids))
        total = alpha[-1] + w[-1]
        if counts is not None and total > -inf:
            beta = [-inf] * len(codes) + [w[-1]]
            for at in range(len(codes) - 1, -1, -1):
                for to, ids in self._arcs_at(codes, named, at):
                    after = sum(w[i] for i in ids) + beta[to]
                    beta[at] = add(beta[at], after)
                    for i in ids:
                        counts[i] += exp(alpha[at] + after - total)
            counts[-1] += 1
        return total


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word, c): how often each word occurs; tasks count before the shuffle."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for part in slices(batches):
            for text in part.column(1).to_pylist():
                counts.update(words_of(text))
            if len(counts) > 500_000:
                yield flush()
        if counts:
            yield flush()

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def words_of(text: str) -> list[str]:
    """Runs of other characters than space and \\t to \\r, A-Z in lower case (of bytes only A-Z have one)."""
    return [w.decode() for w in text.encode().lower().split()]


def _expected(counts: DataFrame, lattice: Lattice, weights: np.ndarray) -> np.ndarray:
    """Expected counts of pieces and ends over the distinct words: one row a piece and task."""

    def run(batches):
        total, held = np.zeros(lattice.n + 1), []
        for batch in batches:
            held += batch.column(0).to_pylist()
            if len(held) >= 65536:
                lattice.run(held, weights, total)
                held = []
        lattice.run(held, weights, total)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    rows = counts.select("word").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(lattice.n + 1)
    out[rows["piece"].to_numpy(int)] = rows["n"].to_numpy()
    return out


def score_texts(docs: DataFrame, model_path: str, train: Column | None = None, strength: float = 1e5, rounds: int = 1, head: int = 200_000) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score (log10 probabilities).

    The tokens are a text's words and one end. base_score is the smoothed unigram
    score of the tokens' counts in the rows to learn from (``train``; by default those
    whose crc32 of the doc_id as text isn't 1 mod 5). lattice_score is the marginal
    probability of the text over all segmentations of its words into the pieces of the existing
    vocabulary, weighted by its own scores alone: nothing is learnt. score is that of the model that learns: the
    vocabulary's weights count as ``strength`` occurrences to which ``rounds`` of expectation maximisation add
    the expected counts of all distinct training words, and a word of the training rows has one more
    segmentation, itself as a whole, which weighs as often as it occurs; whole words together weigh as much as the
    Good-Turing estimate of words seen before. As no piece crosses white space, a text's forward recursion is
    the sum of its words'.

    Words in at most the ``head`` most frequent go to the tasks as a table of proven
    size; all others are looked up by a join, each once a text. A null or empty
    text is the end alone. Rows repeat as in docs; those that share a doc_id are each scored
    and learnt from by their own text. A null doc_id is in neither fold's remainder
    and not learnt from. Words of any length are scored whole. Further columns don't matter. Without
    rows to learn from scores are those of the vocabulary alone and base_score is 0.
    """
    texts = with_id_and_text(docs)
    train = fold("doc_id", 5) != 1 if train is None else train
    learnt = texts.where(F.coalesce(train, F.lit(False)))
    counts = materialise(_word_counts(learnt), "words")
    ends = learnt.count()
    sizes = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()}
    types, total = sum(sizes.values()), sum(c * n for c, n in sizes.items()) + ends
    least, room = max(sizes, default=0) + 1, head
    for c in sorted(sizes, reverse=True):
        if sizes[c] > room:
            break
        least, room = c, room - sizes[c]
    lattice = Lattice(model_path)
    own = weights = lattice.weights
    prior = lattice.counts(strength)
    for _ in range(rounds if types else 0):
        found = _expected(counts, lattice, weights) + prior
        weights = lattice.normal(found[:-1], float(found[-1]))
    both = np.stack([weights, own])
    seen = 1.0 - max(sizes.get(1, 0), 1) / total if types else 0.0  # Good-Turing: words that occur once stand for unseen ones
    floor = total + 0.5 * (types + (ends > 0) + 1)  # V counts the end where a text ends
    top = counts.where(F.col("c") >= least).toPandas() if sizes else None
    known_words = top["word"].tolist() if top is not None else []
    known_counts = top["c"].to_numpy(np.float64) if top is not None else np.empty(0)
    sub, own_of = lattice.run(known_words, both) if known_words else np.empty((2, 0))
    sub, own_of = np.exp(sub), own_of / np.log(10)
    base_of = np.log10((known_counts + 0.5) / floor) if known_words else np.empty(0)
    score_of = np.log10(seen * known_counts / total + (1 - seen) * sub) if known_words else np.empty(0)
    end_base = log10((ends + 0.5) / floor)
    end_score = log10(seen * ends / total) if total and ends and seen else 0.0

    def run(batches):
        place = {w: i for i, w in enumerate(known_words)}
        for part in slices(batches, 2048):  # many words at once keep numpy busy
            split = [words_of(t) for t in part.column(1).to_pylist()]
            tails = [Counter(w for w in words if w not in place) for words in split]
            rare = list(set().union(*tails))
            found = (lattice.run(rare, both) / np.log(10)).T.tolist() if rare else []
            marginal = dict(zip(rare, found))
            cols: list[list] = [[], [], [], [], []]
            for words, rest in zip(split, tails):
                at = np.fromiter((place[w] for w in words if w in place), np.int64)
                plain = own_of[at].sum() + sum(n * marginal[w][1] for w, n in rest.items())
                for c, v in zip(cols, (len(words) + 1, len(at) + (ends > 0), base_of[at].sum() + end_base, score_of[at].sum() + end_score, plain)):
                    c.append(v)
            flat = [w for t in tails for w in t]
            fields = [pa.array(flat, pa.string()), pa.array([n for t in tails for n in t.values()], pa.int64()), pa.array([marginal[w][0] for w in flat], pa.float64())]
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in tails])]).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, ["word", "times", "sub"]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64()), tail], names=["doc_id", "n", "known", "base", "sc", "own", "tail"])

    kinds = "doc_id long, n long, known long, base double, sc double, own double, tail array<struct<word: string, times: long, sub: double>>"
    read = materialise(texts.mapInArrow(run, kinds).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = read.select("row", F.inline("tail")).join(counts.where(F.col("c") < least), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    either = F.log10(seen * F.col("c") / max(total, 1) + (1 - seen) * F.pow(F.lit(10.0), "sub"))
    # a marginal too small for a double is added as a logarithm
    score = F.when(F.col("c") > 0, either).otherwise(F.lit(log10(1 - seen)) + F.col("sub"))
    sums = rest.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / floor)).alias("base_"),
        F.sum(F.col("times") * score).alias("sc_"),
    )
    out = read.drop("tail").join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        "doc_id", (fold("doc_id", 5) == 1).alias("held_out"), F.col("n").alias("n_tokens"), plus("known", "known_").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), plus("base", "base_").alias("base_score"), plus("sc", "sc_").alias("score"), F.col("own").alias("lattice_score"),
    )

"""Runs of periodic words, caught while words are appended."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweave.llm.arrow import map_texts, with_id_and_text
from chronoweave.llm.hashing import RollingHash, mix

_U = np.uint64
#: Periods below this are followed directly; longer ones have catchers of blocks of a quarter to half their length.
SHORT = 8


class SquareCatcher:
    """Catches the runs of a growing sequence of numbers.

    A run is a stretch with smallest period q and at least max(least, 2 * q) long that can't be extended. Every completed
    block of m = 4, 8, 16, ... numbers, [b, b + m) with m dividing b, is a catcher of squares with
    periods from 2 * m to 4 * m - 1: while the numbers b + 2 * m to b + 5 * m - 2 are appended, the last m of them are compared
    with the block by their rolling hash. In a run of such a period, numbers q apart are equal over q places at
    least, and these hold a whole block, so that its catcher meets the square; one more comparison, halving its
    step, finds how far the equal places reach to both sides. Places that are equal up to the end are
    advanced by each append() until they break. Blocks of which the square lies in a run caught
    before, whose period divides q, are skipped. What hashes say is compared number by number before it counts.
    """

    _roll = RollingHash()

    def __init__(self, least: int = 12):
        self.least, self.n = least, 0
        self.x, self.sums = np.empty(256, np.int64), np.zeros(257, _U)
        self.ended: dict[tuple[int, int], int] = {}  # (start, end): smallest period
        self.open: dict[int, int] = {}  # period: first of the places that are equal up to the end

    def append(self, numbers: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(numbers)
        if self.n > len(self.x):
            self.x = np.concatenate([self.x[:old], np.empty(self.n, np.int64)])
            self.sums = np.concatenate([self.sums[: old + 1], np.empty(self.n, _U)])
        self._roll.powers(len(self.x) + 1)
        self.x[old : self.n] = numbers
        with np.errstate(over="ignore"):
            terms = mix(numbers.astype(_U) + _U(1)) * self._roll.up[old : self.n]
            self.sums[old + 1 : self.n + 1] = self.sums[old] + np.cumsum(terms, dtype=_U)
        self._advance(old)
        for q in range(1, min(SHORT, self.n)):
            self._follow(q, old)
        m = SHORT // 2
        while 3 * m <= self.n:
            self._meet(m, old)
            m *= 2

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of what has been appended, by start and period."""
        found = dict(self.ended)
        for q, s in self.open.items():
            if self._long(s, self.n - q, q):
                found[s, self.n] = min(q, found.get((s, self.n), q))
        return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))

    def _long(self, s: int, t: int, q: int) -> bool:
        return t - s >= max(q, self.least - q)

    def _exact(self, s: int, t: int, q: int) -> bool:
        """Whether numbers q apart are equal at the places s to t - 1 and at neither neighbour."""
        x = self.x
        return (s == 0 or x[s - 1] != x[s - 1 + q]) and (t + q == self.n or x[t] != x[t + q]) and np.array_equal(x[s:t], x[s + q : t + q])

    def _end(self, s: int, t: int, q: int) -> None:
        """The equal places s to t - 1 are over; if they make a run it is kept."""
        if not self._long(s, t, q):
            return
        if self._exact(s, t, q):
            self.ended[s, t + q] = min(q, self.ended.get((s, t + q), q))
        else:
            self._redo(q)

    def _stay(self, s: int, q: int) -> None:
        """The places from s on are equal up to the end; once they make a run, that is made sure of."""
        self.open[q] = s
        if self._long(s, self.n - q, q) and not self._exact(s, self.n - q, q):
            self._redo(q)

    def _redo(self, q: int) -> None:
        """Hashes erred: all equal places of this period anew."""
        self.open.pop(q, None)
        for s, t in self._equal(q, 0):
            if t + q == self.n:
                self.open[q] = s
            elif self._long(s, t, q):
                self.ended[s, t + q] = min(q, self.ended.get((s, t + q), q))

    def _equal(self, q: int, begin: int) -> list[tuple[int, int]]:
        """Stretches of equal places from begin on, found one by one."""
        same = self.x[begin : self.n - q] == self.x[begin + q : self.n]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8))) + begin
        return list(zip(edge[::2].tolist(), edge[1::2].tolist()))

    def _follow(self, q: int, old: int) -> None:
        begin = max(0, old - q)
        before = self.open.pop(q, None)
        if self.n - q <= begin:
            return
        same = self.x[begin : self.n - q] == self.x[begin + q : self.n]
        if before is None and not same.any():
            return
        edge = np.flatnonzero(same[1:] != same[:-1]) + 1
        edge = np.concatenate([[0] if same[0] else [], edge, [len(same)] if same[-1] else []]).astype(np.int64) + begin
        first, last = edge[::2], edge[1::2]
        if before is not None:
            if same[0]:
                first[0] = before
            else:
                self._end(before, begin, q)
        wide = (last - first >= max(q, self.least - q)) | (last + q == self.n)
        for s, t in zip(first[wide].tolist(), last[wide].tolist()):
            if t + q == self.n:
                self.open[q] = s
            else:
                self._end(s, t, q)

    def _reach(self, at: np.ndarray, q: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """How many places from at on (way 1) or before it (way -1) are equal, most at most, by hashes."""
        got, step = np.zeros(len(at), np.int64), 1 << int(most.max(initial=0)).bit_length()
        up, sums = self._roll.up[q], self.sums
        while step:
            wider = np.minimum(got + step, most)
            a = at if way > 0 else at - wider
            with np.errstate(over="ignore"):
                same = (sums[a + wider] - sums[a]) * up == sums[a + q + wider] - sums[a + q]
            got = np.where(same, wider, got)
            step //= 2
        return got

    def _advance(self, old: int) -> None:
        """Places that were equal up to the end meet the new numbers; short periods are followed elsewhere."""
        held = [(q, s) for q, s in self.open.items() if q >= SHORT]
        if not held:
            return
        q, s = np.array(held, np.int64).T
        more = self._reach(old - q, q, np.full(len(q), self.n - old), 1)
        for p, a, k in zip(q.tolist(), s.tolist(), more.tolist()):
            del self.open[p]
            if k < self.n - old:
                self._end(a, old - p + k, p)
            else:
                self._stay(a, p)

    def _meet(self, m: int, old: int) -> None:
        """Compares the new windows of m numbers with the blocks two and three before their own."""
        first = max(2 * m, old - m + 1)
        i = np.arange(first, self.n - m + 1)
        with np.errstate(over="ignore"):
            named = (self.sums[i + m] - self.sums[i]) * self._roll.down[i]
            b = np.arange(max(0, first // m - 3), (self.n - m) // m - 1) * m
            blocks = (self.sums[b + m] - self.sums[b]) * self._roll.down[b]
        at = i // m - 2 - (b[0] // m if len(b) else 0)
        hit, far = blocks[at] == named, np.zeros(len(i), bool)
        early = max(0, 3 * m - first)  # windows without a block three before
        far[early:] = blocks[at[early:] - 1] == named[early:]
        if not (hit.any() or far.any()):
            return
        i = np.concatenate([i[hit], i[far]])
        b = np.concatenate([b[at[hit]], b[at[far] - 1]])
        keep = ~self._covered(b, i - b, m)
        b, q = b[keep], (i - b)[keep]
        if not len(b):
            return
        order = np.lexsort((b, q))
        b, q = b[order], q[order]
        new = np.ones(len(b), bool)
        new[1:] = (q[1:] != q[:-1]) | (b[1:] != b[:-1] + m)
        head = np.flatnonzero(new)
        q, s, t = q[head], b[head], b[np.append(head[1:], len(b)) - 1] + m
        known = np.array([self.open.get(p, self.n) <= a for p, a in zip(q.tolist(), s.tolist())], bool)
        q, s, t = q[~known], s[~known], t[~known]
        s = s - self._reach(s, q, np.minimum(s, m), -1)
        t = t + self._reach(t, q, np.minimum(self.n - q - t, m), 1)
        open_ = t + q == self.n
        wide = open_ | (t - s >= q)
        for p, a, c in zip(q[wide].tolist(), s[wide].tolist(), t[wide].tolist()):
            if c + p == self.n:
                self._stay(a, p)
            else:
                self._end(a, c, p)

    def _covered(self, b: np.ndarray, q: np.ndarray, m: int) -> np.ndarray:
        """Which squares' blocks and windows lie in a run of a period that divides q."""
        runs = [(s, e, p) for (s, e), p in self.ended.items() if e - s >= 3 * m]
        runs += [(s, self.n, p) for p, s in self.open.items() if self.n - s >= 3 * m and self._long(s, self.n - p, p)]
        out = np.zeros(len(b), bool)
        if runs:
            order = np.argsort(b, kind="stable")
            sorted_b, sorted_q = b[order], q[order]
            hidden = np.zeros(len(b), bool)
            for s, e, p in runs:
                lo, hi = np.searchsorted(sorted_b, (s, e))
                if lo < hi:
                    hidden[lo:hi] |= (sorted_q[lo:hi] % p == 0) & (sorted_b[lo:hi] + sorted_q[lo:hi] + m <= e)
            out[order] = hidden
        return out


def word_runs(words: list[bytes], least: int = 12, chunk: int = 1 << 16) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, appended chunk by chunk."""
    table: dict[bytes, int] = {}
    numbers = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))
    catcher = SquareCatcher(least)
    for at in range(0, len(numbers), chunk):
        catcher.append(numbers[at : at + chunk])
    return catcher.runs()


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents end in a repeated phrase: the contract's cases, chosen by the crc32 of the id. Those without an id stay."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        drop[s + q] += 1
        drop[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
SPANS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, least: int = 12, edited: bool = False, with_text: bool = False) -> DataFrame:
    """Per row of docs: its runs of periodic words, in digests, and, with_text, in full with the collapsed text.

    Words are what ASCII white space separates, unchanged. A run is a stretch of words with smallest period q, of at least
    max(least, 2 * q) words, that no neighbouring word extends; the longest one (ties: least start, then period) gives start, length, period
    and exponent_milli, nulls if there is none. A word that a run holds beyond its first period is dropped from the collapsed text. With edited, texts are
    those of planted(). A null or empty text has no words; texts are read whole in chunks of 65,536 words, of which the catchers keep sums and ends;
    rows that share a doc_id or have none are rows of their own; further columns don't matter; no rows give no rows.
    Texts don't meet, so nothing is shuffled.
    """
    def make():
        def work(ids, texts):
            rows = []
            for doc_id, text in zip(ids, texts):
                words = text.encode().split()
                if edited:
                    words = planted(doc_id, words)
                runs = word_runs(words, least)
                top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                left = b" ".join(collapse(words, runs))
                row = [doc_id, len(runs), *top, top[1] * 1000 // top[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()]
                rows.append(row + [left.decode(), [dict(zip(("start", "length", "period"), r)) for r in runs]] * with_text)
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.string(), pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))] * with_text
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

        return work

    more = f", collapsed_text string, runs {SPANS}" if with_text else ""
    fields = [f.split()[0] for f in SCHEMA.split(", ")] + ["collapsed_text", "runs"] * with_text
    return map_texts(with_id_and_text(docs), make, SCHEMA + more, fields)

"""Suffix arrays of short byte strings in numpy: built by prefix doubling, merged by binary search on bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_STEPS = _U(1) << (_U(8) * np.arange(1, 8, dtype=_U))


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number that orders like them; zeros after the end."""
    padded = np.concatenate([text, np.zeros(7, np.uint8)])
    out = np.zeros(len(text), _U)
    for k in range(8):
        out = (out << _U(8)) | padded[k : k + len(text)]
    return out


def compare(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes at i (of a text with words x) and at j (of one with words y): how many of their first ``length``
    bytes they have in common, and whether the first one comes before the second."""
    same, less = np.full(len(i), length), np.zeros(len(i), bool)
    alive = np.arange(len(i))
    for k in range(0, length, 8):
        beyond = max(0, k + 8 - length)
        a, b = (w[at[alive] + k] >> _U(8 * beyond) for w, at in ((x, i), (y, j)))
        gap = a ^ b
        apart = gap != 0
        at = alive[apart]
        same[at] = k + 7 - beyond - np.searchsorted(_STEPS, gap[apart], side="right")
        less[at] = (a < b)[apart]
        alive = alive[~apart]
        if not len(alive):
            break
    return same, less


@dataclass
class SuffixArray:
    """The suffixes of some strings that have ``length`` bytes or more, in the byte order of those first bytes.

    text: the strings in a row, string k from bounds[k] to bounds[k + 1], which comes from row owner[k] at byte at[k].
    order: where the suffixes start in text; shared: how many bytes each has in common with the one before it, at
    most length.
    """

    length: int
    text: np.ndarray
    bounds: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    order: np.ndarray
    shared: np.ndarray

    @classmethod
    def build(cls, strings: list[bytes], owner: np.ndarray, at: np.ndarray, length: int) -> SuffixArray:
        text = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(s) for s in strings], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        room = np.maximum(sizes - length + 1, 0)
        starts = np.arange(room.sum()) + np.repeat(bounds[:-1] - (np.cumsum(room) - room), room)
        out = cls(length, text, bounds, owner, at, starts, np.zeros(len(starts), np.int64))
        if not len(starts):
            return out
        w, n = words(text), len(text)
        h = 8
        while h > length:
            h //= 2
        rank = np.unique(w[: n - h + 1] >> _U(8 * (8 - h)), return_inverse=True)[1]
        while 2 * h <= length:
            rank = np.unique(rank[: n - 2 * h + 1] * (n + 1) + rank[h : n - h + 1], return_inverse=True)[1]
            h *= 2
        out.order = starts[np.argsort(rank[starts] * (n + 1) + rank[starts + length - h], kind="stable")]
        out.shared[1:] = compare(w, out.order[:-1], w, out.order[1:], length)[0]
        return out

    def places(self, other: SuffixArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many suffixes of other come before each of these; x and y are the two texts' words."""
        low, high = np.zeros(len(self.order), np.int64), np.full(len(self.order), len(other.order))
        open_ = np.arange(len(self.order)) if len(other.order) else np.empty(0, np.int64)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            before = compare(y, other.order[middle], x, self.order[open_], self.length)[1]
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]
            open_ = open_[low[open_] < high[open_]]
        return low

    def merge(self, other: SuffixArray) -> SuffixArray:
        x, y = words(self.text), words(other.text)
        n = len(self.order) + len(other.order)
        mine = np.arange(len(self.order)) + self.places(other, x, y)
        theirs = np.ones(n, bool)
        theirs[mine] = False
        order = np.empty(n, np.int64)
        order[mine], order[theirs] = self.order, other.order + len(self.text)
        text = np.concatenate([self.text, other.text])
        shared = np.zeros(n, np.int64)
        w = np.concatenate([x, y])  # no suffix of length bytes reaches over the end of its text
        shared[1:] = compare(w, order[:-1], w, order[1:], self.length)[0]
        bounds = np.concatenate([self.bounds, other.bounds[1:] + len(self.text)])
        return SuffixArray(self.length, text, bounds, np.concatenate([self.owner, other.owner]), np.concatenate([self.at, other.at]), order, shared)

    def repeated(self) -> np.ndarray:
        """Which positions of text begin a suffix whose first length bytes another one begins with too."""
        long = self.shared >= self.length
        out = np.zeros(len(self.text), bool)
        out[self.order[long]] = True
        out[self.order[:-1][long[1:]]] = True
        return out

    def runs(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, start and end of the bytes that runs of hit positions cover, in each string apart."""
        p = np.flatnonzero(hit)
        k = np.searchsorted(self.bounds, p, side="right") - 1
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1] + 1) | (k[1:] != k[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1 if len(p) else first
        move = (self.at - self.bounds[:-1])[k[first]]
        return self.owner[k[first]], p[first] + move, p[last] + move + self.length

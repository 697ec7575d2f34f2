"""Vectorised 64-bit hashes of bytes, words and word shingles."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_U = np.uint64
#: Of eight bytes, the first 0 to 8.
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


class RollingHash:
    """Hashes of any range of a byte string from one pass: sum of T[byte] * B^i (mod 2^64) as prefix sums."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 7):
        self.table = constants(256, seed)
        self.up = self.down = np.ones(1, _U)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = pow(self.BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                one = np.ones(1, _U)
                self.up = np.cumprod(np.concatenate([one, np.full(n - 1, self.BASE, _U)]), dtype=_U)
                self.down = np.cumprod(np.concatenate([one, np.full(n - 1, inverse, _U)]), dtype=_U)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[data] * self.up[: len(data)], dtype=_U, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(_U))

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """As ranges(), of all ranges of that size."""
        with np.errstate(over="ignore"):
            return mix((prefix[size:] - prefix[:-size]) * self.down[: len(prefix) - size] + _U(size))


class WordCodes(dict):
    """64 bits of a keyed BLAKE2 of each word; words of up to 64 bytes are kept, at most ``most`` of them before it starts anew."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        code = int.from_bytes(blake2b(word, digest_size=8, key=b"chronoweave").digest(), "little")
        if len(word) <= 64:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each word (runs of other bytes than space and \\t to \\r) of all texts, one after the other, and how many words each text has.

    Words of up to 64 bytes are mixed eight bytes at a time, a step that keeps unlike eight bytes apart; longer ones get bits of a BLAKE2.
    """
    raw = b" ".join([b"", *texts, b" " * 8])
    data = np.frombuffer(raw, np.uint8)
    space = (data == 32) | (data - np.uint8(9) <= 4)
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    sizes = ends - starts
    eight = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    with np.errstate(over="ignore"):
        codes = sizes.astype(_U) * _U(RollingHash.BASE)
        open_ = slice(None)
        for k in range(0, min(64, sizes.max(initial=0)), 8):
            if k:
                open_ = np.flatnonzero((sizes > k) & (sizes <= 64))
            codes[open_] = mix(codes[open_] + (eight[starts[open_] + k] & _HEADS[np.minimum(sizes[open_] - k, 8)]))
    for i in np.flatnonzero(sizes > 64).tolist():
        codes[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]], digest_size=8, key=b"chronoweave").digest(), "little")
    stops = np.cumsum([0, *(len(t) + 1 for t in texts)])  # each text begins after one space
    return codes, np.diff(np.searchsorted(starts, stops + 1))


def words_of(text: str) -> list[bytes]:
    """Runs of other characters than space and \\t to \\r, A-Z in lower case (of bytes only A-Z have one)."""
    return text.encode().lower().split()


class Shingler:
    """Word shingles of texts as 64-bit hashes of their words' codes."""

    def __init__(self, words: int = 5):
        self.words, self.codes, self.k = words, WordCodes(), constants(words + 1, 99)

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """A text's sorted distinct shingles; with fewer words the whole sequence as one; without words none."""
        if not words:
            return np.empty(0, _U)
        h, n = self.codes.of(words), min(self.words, len(words))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - n + 1, n, _U) * self.k[self.words]
            for i in range(n):
                total += mix(h[i : len(h) - n + 1 + i] + self.k[i]) * self.k[i]
            return np.unique(mix(total))


def common_shingles(a: list[bytes], b: list[bytes], words: int) -> tuple[int, int, int]:
    """The sizes of two texts' sets of shingles and of what they have in common, by the words themselves; both have words.

    Words are numbered by a table of both texts; a shingle's number grows word by
    word as the rank of (number so far, next word), so that equal numbers are equal words.
    """
    table: dict[bytes, int] = {}
    numbers = np.fromiter((table.setdefault(w, len(table)) for side in (a, b) for w in side), np.int64, len(a) + len(b))
    sides = [numbers[: len(a)], numbers[len(a) :]]
    n = min(words, max(len(a), len(b)))
    counts = [max(1, len(side) - n + 1) for side in sides]
    sides = [np.concatenate([side, np.full(max(0, n - len(side)), len(table))]) for side in sides]  # a shorter text is one shingle of its own
    at = np.concatenate([side[:c] for side, c in zip(sides, counts)])
    for i in range(1, n):
        after = np.concatenate([side[i : i + c] for side, c in zip(sides, counts)])
        at = np.unique(at * (len(table) + 1) + after, return_inverse=True)[1]
    left, right = np.unique(at[: counts[0]]), np.unique(at[counts[0] :])
    return len(left), len(right), len(np.intersect1d(left, right, assume_unique=True))

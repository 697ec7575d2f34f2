"""Removal of word windows that a document with a smaller id holds too."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.arrow import slices
from chronoweave.llm.hashing import RollingHash, word_codes
from chronoweave.session import intermediate, materialise

_U = np.uint64
_LOW = _U(0xFFFFFF)
#: Bytes of texts, or words of a longer text, that are hashed at once; positions of words in them fit 24 bits.
BLOCK = 1 << 20
#: Rows that are read at once.
ROWS = 1024
#: Packs of one batch whose names are counted at once.
PACKS = 1 << 20
#: The id that rows without one are given: they come after all others.
LAST = 2**63 - 1


class WindowHasher:
    """Rabin-Karp hashes of all windows of ``size`` words, and packs of windows that follow one another.

    A window is given to the ``gram``-word string in it that has the least hash (the last one of equals). That choice
    depends on the window's words alone. Neighbouring windows that choose the same string are a pack, of at most size - gram + 1
    windows. Its name is the hash of that string and its code that of all its words; equal windows are in packs of the same name.
    """

    def __init__(self, size: int, gram: int = 4):
        if not gram < size <= gram + 15:
            raise ValueError("a window holds between 1 and 15 words more than a gram")
        self.size, self.gram = size, gram
        self.roll = RollingHash()

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Prefix sums of code * B^i (mod 2^64), from which ranges() makes the hash of any range of words."""
        self.roll.powers(len(codes) + 1)
        out = np.zeros(len(codes) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(codes * self.roll.up[: len(codes)], dtype=_U, out=out[1:])
        return out

    def windows(self, texts: list[bytes], text: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start at these words of these texts (indices)."""
        codes, lengths = word_codes(texts)
        at = (np.cumsum(lengths) - lengths)[text] + start
        return self.roll.ranges(self.sums(codes), at, at + self.size).view(np.int64)

    def packs(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """text (index), start, number of windows, name and code of the packs of all texts together, by the words' codes and each text's number of words."""
        size, gram = self.size, self.gram
        stops = np.cumsum(lengths)
        starts = stops - lengths
        if len(codes) < size:
            none = np.empty(0, np.int64)
            return none, none, none, none, none
        sums = self.sums(codes)
        named = self.roll.windows(sums, gram)
        low = (named & ~_LOW) | (_LOW - np.arange(len(named), dtype=_U))
        width, have = size - gram + 1, 1
        while have < width:  # the least of a window from those of two shorter ones; of the window that starts at each word in the end
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        new = np.ones(len(low) + 1, bool)
        new[1:-1] = low[1:] != low[:-1]
        new[starts[starts < len(low)]] = True
        new[np.maximum(stops - size + 1, starts).clip(max=len(low))] = True  # from here on windows would reach into the next text
        first = np.flatnonzero(new)
        first, last = first[:-1], first[1:] - 1
        text = np.searchsorted(stops, first, side="right")
        inside = first + size <= stops[text]
        text, first, last = text[inside], first[inside], last[inside]
        code = self.roll.ranges(sums, first, last + size)
        chosen = (_LOW - (low[first] & _LOW)).astype(np.int64)
        return text, first - starts[text], last - first + 1, named[chosen].view(np.int64), code.view(np.int64)

    def packs_in_blocks(self, texts: list[bytes] | list[list[bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        """As packs(), of as many texts (or their words) at once as make BLOCK bytes; one of more words is cut, its windows follow on one another."""
        texts = [t if isinstance(t, bytes) else b" ".join(t) for t in texts]
        for at, to in _groups(texts):
            codes, lengths = word_codes(texts[at:to])
            if to > at + 1 or len(codes) <= BLOCK:
                text, *rest = self.packs(codes, lengths)
                yield text + at, *rest
                continue
            for begin in range(0, len(codes) - self.size + 1, BLOCK - self.size + 1):
                some = codes[begin : begin + BLOCK]
                text, start, *rest = self.packs(some, np.array([len(some)]))
                yield text + at, start + begin, *rest


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of BLOCK bytes together, or one of more, by their indices."""
    at = 0
    while at < len(texts):
        to, held = at + 1, len(texts[at])
        while to < len(texts) and held + len(texts[to]) <= BLOCK:
            held, to = held + len(texts[to]), to + 1
        yield at, to
        at = to


def _lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """A column of lists of structs as the lists' edges and the structs' fields, one after the other; a null is an empty list."""
    n = np.array(pc.fill_null(pc.list_value_length(column), 0))
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(n)]), [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _members(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of packs: its pack and its place there."""
    n = at & 15
    owner = np.repeat(np.arange(len(at)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _scan(docs: DataFrame, hasher: Callable[[], WindowHasher], whole: bool) -> DataFrame:
    """whole: every pack as (name, code, doc, twin, at), at holding start * 16 + number of windows; else each name of a batch with its least and greatest document."""
    fields = ["name", "code", "doc", "twin", "at"] if whole else ["name", "low", "high"]

    def ends(names, docs):
        name, doc = np.concatenate(names), np.concatenate(docs)
        order = np.lexsort((doc, name))
        name, doc = name[order], doc[order]
        new = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
        return [name[new], doc[new], doc[np.append(new[1:], len(name))[: len(new)] - 1]]

    def run(batches):
        make = hasher()
        for batch in slices(batches, ROWS):
            doc, twin = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            names, docs, held = [], [], 0
            for text, start, n, name, code in make.packs_in_blocks([t.encode() for t in batch.column(2).to_pylist()]):
                if whole:
                    cols = [name, code, doc[text], twin[text], start * 16 + n]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=fields)
                    continue
                names.append(name)
                docs.append(doc[text])
                held += len(name)
                if held > PACKS:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in ends(names, docs)], names=fields)
                    names, docs, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in ends(names, docs)], names=fields)

    return docs.select("doc", "twin", "text").mapInArrow(run, ", ".join(f"{f} long" for f in fields))


def _opened(docs: DataFrame, probes: DataFrame, hasher: Callable[[], WindowHasher]) -> DataFrame:
    """Each window of the packs in probes (doc, twin, packs) by itself: (name, code, low, k, window), k its place in the pack."""

    def run(batches):
        make = hasher()
        for batch in slices(batches, ROWS):
            doc, edge, (at, name, code) = batch.column(0).to_numpy(), *_lists(batch.column(2), "at", "name", "code")
            owner, k = _members(at)
            start = (at >> 4)[owner] + k
            found = np.empty(len(start), np.int64)
            cut = np.searchsorted(owner, edge)  # of each text's windows
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            text = np.repeat(np.arange(len(texts)), np.diff(cut))
            for i, to in _groups(texts):
                some = slice(cut[i], cut[to])
                found[some] = make.windows(texts[i:to], text[some] - i, start[some])
            low = np.repeat(doc, np.diff(edge))
            cols = [name[owner], code[owner], low[owner], k, found]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["name", "code", "low", "k", "window"])

    return docs.join(probes, ["doc", "twin"]).select("doc", "text", "packs").mapInArrow(run, "name long, code long, low long, k long, window long")


def _cut(docs: DataFrame, size: int, with_text: bool) -> DataFrame:
    fields = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text", "spans"] * with_text

    def run(batches):
        for batch in slices(batches, ROWS):
            rows, (edge, (at, late)) = [], _lists(batch.column(2), "at", "late")
            owner, k = _members(at)
            start = ((at >> 4)[owner] + k)[hit := (late[owner] >> k & 1).astype(bool)]
            cut = np.searchsorted(owner[hit], edge)
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                words = text.encode().split()
                kept, spans, starts = words, [], start[cut[i] : cut[i + 1]]
                if len(starts):
                    ends = np.zeros(len(words) + 1, np.int64)
                    ends[starts] += 1
                    ends[starts + size] -= 1
                    gone = np.cumsum(ends)[:-1] > 0
                    kept = list(compress(words, (~gone).tolist()))
                    if with_text:
                        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).view(np.int8))).tolist()
                        spans = [list(s) for s in zip(turn[::2], turn[1::2])]
                left = b" ".join(kept)
                rows.append([doc_id, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest()] + [left.decode(), spans] * with_text)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in zip(range(len(fields)), kinds)], names=fields)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, spans array<array<long>>" * with_text
    return docs.select("doc_id", "text", "packs").mapInArrow(run, schema)


def late_windows(docs: DataFrame, size: int = 13, gram: int = 4) -> DataFrame:
    """(doc, twin, packs): the packs of docs (doc, twin, text) with windows that a smaller doc holds too; late has a bit for each window.

    Every window is hashed and counted in Spark, first in packs: a pack whose name only one document has holds no repeated window. Of a name
    that several have, equal packs (by name and code, 128 bits) are counted as one, and where its packs differ, their windows are
    counted one by one (by name and hash), once for each kind of pack, not for each document that holds it.
    """
    hasher = lambda: WindowHasher(size, gram)
    names = _scan(docs, hasher, whole=False).groupBy("name").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("name")
    names = materialise(names, "names")
    live = materialise(_scan(docs, hasher, whole=True).join(names, "name"), "live")
    kinds = live.groupBy("name", "code").agg(F.min(F.struct("doc", "twin", "at")).alias("o"))
    kinds = materialise(kinds.select("name", "code", "o.*"), "kinds")
    several = materialise(kinds.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "several")
    pack = F.struct("name", "code", "at")
    probes = materialise(kinds.join(several, "name").groupBy("doc", "twin").agg(F.collect_list(pack).alias("packs")), "probes")
    windows = materialise(_opened(docs.dropDuplicates(["doc", "twin"]) if _has_twins(docs) else docs, probes, hasher), "windows")
    least = windows.groupBy("name", "window").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most").select("name", "window", "least")
    late = windows.join(materialise(least, "least"), ["name", "window"]).where("low > least")
    late = materialise(late.groupBy("name", "code").agg(F.bit_or(F.expr("shiftleft(1, CAST(k AS INT))")).alias("bits")), "late")
    kinds = kinds.select("name", "code", F.col("doc").alias("low")).join(late, ["name", "code"], "left")
    rows = live.join(materialise(kinds, "marked"), ["name", "code"])
    rows = rows.withColumn("late", F.when(F.col("doc") > F.col("low"), (1 << 15) - 1).otherwise(F.col("bits"))).where("late <> 0")
    return materialise(rows.groupBy("doc", "twin").agg(F.collect_set(F.struct("at", "late")).alias("packs")), "packs")


def _has_twins(docs: DataFrame) -> bool:
    return not docs.groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").isEmpty()


def remove_repeated_windows(docs: DataFrame, size: int = 13, gram: int = 4, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with_text, the kept words and the removed spans of words.

    A window is ``size`` consecutive words (what ASCII white space separates, unchanged) of one text. A window that a document with a
    smaller doc_id holds too is removed; removed windows that touch or overlap are one span; windows are judged on the input. Rows that
    share a doc_id take nothing from each other; rows without one come after all others and
    take nothing from each other either. A null or empty text has no words, one with fewer than size words no window. Texts of any
    length are read whole; repeated rows are each cut as one; further columns don't matter; no rows give no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    twin = F.xxhash64("text") if _has_twins(keyed) else F.lit(0).cast("long")  # tells the texts of one doc_id apart
    keyed = keyed.withColumn("twin", twin)
    with intermediate(docs.sparkSession) as keep:
        found = late_windows(keyed, size, gram)
        return keep(_cut(keyed.join(found, ["doc", "twin"], "left"), size, with_text))

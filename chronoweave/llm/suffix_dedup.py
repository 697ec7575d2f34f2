"""Removal of long repeated byte strings with a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.arrow import slices, with_id_and_text
from chronoweave.llm.hashing import RollingHash, mix
from chronoweave.llm.suffix_array import SuffixArray
from chronoweave.session import intermediate, materialise

_U = np.uint64
_LOW = _U(0xFFFFFF)
#: Bytes of text that are scanned at once; positions in them fit 24 bits.
BLOCK = 1 << 20
#: Bytes of strings that a shard of the family holds on average, of all batches together.
SHARD = 1 << 20
#: Different segments of one name that stay together in a shard (1.5 MB of bytes); beyond it strings are counted over all tasks.
ALIKE = 4096
#: Parts that the strings of a segment are told apart in at most, by their distance to the chosen suffix.
PARTS = 4
#: Ids that are broadcast at most (8 MB); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000


class Segmenter:
    """Cuts the starts of all ``length``-byte strings of a text into segments at sampled suffixes.

    Each string of ``length`` bytes is given to the suffix, among those that start in
    its first length - gram + 1 bytes, whose first ``gram`` bytes have the least hash (the last
    one of equals). That choice depends on the string alone: equal strings choose
    the same suffix at the same distance. Neighbouring strings that choose the
    same suffix are a segment. Its name is a hash of the suffix's first ``gram`` bytes;
    names only choose what is compared, so that a collision costs time and nothing else.
    """

    def __init__(self, length: int, gram: int = 32):
        self.length, self.gram = length, gram
        self.part = -(-(length - gram + 1) // PARTS)
        self.roll = RollingHash(11)

    def segments(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """doc (index), start, count, name and gap of the segments of all texts together; gap is how far the chosen suffix is from the start."""
        length, gram = self.length, self.gram
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        stops = np.cumsum(sizes)
        starts = stops - sizes
        if len(data) < length:
            e = np.empty(0, np.int64)
            return e, e, e, e, e
        named = self.roll.windows(self.roll.prefix(data), gram)
        low = (named & ~_LOW) | (_LOW - np.arange(len(named), dtype=_U))
        width, have = length - gram + 1, 1
        while have < width:  # the least of a window from those of two shorter windows; of the string that starts at each byte in the end
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        new = np.ones(len(low) + 1, bool)
        new[1:-1] = low[1:] != low[:-1]
        new[starts[starts < len(low)]] = True
        new[np.maximum(stops - length + 1, starts).clip(max=len(low))] = True  # from here on strings would reach into the next text
        first = np.flatnonzero(new)
        first, last = first[:-1], first[1:] - 1
        doc = np.searchsorted(stops, first, side="right")
        inside = first + length <= stops[doc]
        doc, first, last = doc[inside], first[inside], last[inside]
        chosen = (_LOW - (low[first] & _LOW)).astype(np.int64)
        return doc, first - starts[doc], last - first + 1, named[chosen].view(np.int64), chosen - first

    def contexts(self, texts: list[bytes], gaps: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each segment (its bytes, gap and name): how many keys it has, and the keys of all of them, one after the other.

        Strings of a segment are told apart by their distance to the chosen suffix, in parts of as many distances. A key is a
        hash of the bytes that all strings of a part have, with the part's number and the name. Equal strings of
        two segments are in the same part of both, and so have a key in common.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        least, most = (gaps - sizes + self.length) // self.part, gaps // self.part
        n = most - least + 1
        owner = np.repeat(np.arange(len(texts)), n)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + least[owner]
        at = (begin + gaps)[owner] - part * self.part
        prefix = self.roll.prefix(np.frombuffer(b"".join(texts), np.uint8))
        with np.errstate(over="ignore"):
            return n, mix(self.roll.ranges(prefix, at, at + self.length - self.part + 1) + names.view(_U)[owner] + part.astype(_U)).view(np.int64)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _scan(keyed: DataFrame, segmenter: Segmenter) -> DataFrame:
    """The segments of all texts with 128 bits of a BLAKE2 of the bytes that they cover."""

    def run(batches):
        for part in slices(batches):
            rows, texts = part.column(0).to_numpy(), [t.encode() for t in part.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, held = at + 1, len(texts[at])
                while to < len(texts) and held + len(texts[to]) <= BLOCK:
                    held, to = held + len(texts[to]), to + 1
                doc, start, count, name, gap = _long(segmenter, texts[at:to])
                some = texts[at:to]
                reach = segmenter.length - 1
                codes = b"".join(_digest(some[d][s : s + n + reach]) for d, s, n in zip(doc.tolist(), start.tolist(), count.tolist()))
                codes = np.frombuffer(codes, np.int64).reshape(-1, 2)
                cols = [rows[at:to][doc], start, count.astype(np.int32), gap.astype(np.int32), name, codes[:, 0], codes[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["row", "start", "n", "gap", "name", "d1", "d2"])
                at = to

    return keyed.select("row", "text").mapInArrow(run, "row long, start long, n int, gap int, name long, d1 long, d2 long")


def _long(segmenter: Segmenter, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """As segments(); a text of more than BLOCK bytes is scanned in blocks whose strings follow on one another."""
    if len(texts) > 1 or len(texts[0]) <= BLOCK:
        return segmenter.segments(texts)
    step = BLOCK - segmenter.length + 1
    found = [segmenter.segments([texts[0][at : at + BLOCK]]) for at in range(0, len(texts[0]) - segmenter.length + 1, step)]
    doc, start, *rest = (np.concatenate(c) for c in zip(*found))
    return doc, start + np.repeat(np.arange(len(found)) * step, [len(f[0]) for f in found]), *rest


def _affected(keyed: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keyed that are in rows, and the others, read apart; the others are None where there are too many to broadcast."""
    ids = rows.select("row").distinct()
    if ids.count() > BROADCAST_IDS:
        return keyed.join(ids, "row", "left_semi"), None
    return keyed.join(F.broadcast(ids), "row", "left_semi"), keyed.join(F.broadcast(ids), "row", "left_anti")


def _spelled(near: DataFrame, probes: DataFrame, segmenter: Segmenter) -> DataFrame:
    """The probed segments with the bytes that their strings cover and the keys of their parts."""
    names = ["name", "row", "start", "alike", "gap", "bytes", "keys"]

    def run(batches):
        for part in slices(batches):
            rows = []
            for row, text, at in zip(*(part.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                rows += [(s["name"], row, s["start"], s["alike"], s["gap"], raw[s["start"] : s["start"] + s["n"] + segmenter.length - 1]) for s in at]
            cols = list(zip(*rows))
            n, keys = segmenter.contexts(cols[5], np.array(cols[4], np.int64), np.array(cols[0], np.int64))
            keys = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(keys))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary()), keys], names=names)

    schema = "name long, row long, start long, alike long, gap long, bytes binary, keys array<long>"
    return near.join(probes, "row").select("row", "text", "at").mapInArrow(run, schema)


def _alike(spelled: DataFrame, length: int, size: int) -> DataFrame:
    """(name, row, start, alike, bytes) of the parts of segments that have a key in common with another segment; neighbouring parts stay together."""
    key = spelled.select("row", "start", F.posexplode("keys").alias("k", "key"))
    twice = key.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    parts = key.join(twice, "key").groupBy("row", "start").agg(F.collect_list("k").alias("parts"))

    def run(batches):
        for part in slices(batches):
            rows = []
            for name, row, start, alike, gap, text, parts in zip(*(part.column(i).to_pylist() for i in range(7))):
                least, end = (gap - len(text) + length) // size, len(text) - length + 1
                # a part's strings start at gap - its distances; part by part they go from the right to the left
                spans = [(max(gap - (least + k + 1) * size + 1, 0), min(gap - (least + k) * size + 1, end)) for k in sorted(parts, reverse=True)]
                rows += [(name, row, start + s, alike, text[s : e + length - 1]) for s, e in _runs(*zip(*spans))]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["name", "row", "start", "alike", "bytes"])

    columns = ["name", "row", "start", "alike", "gap", "bytes", "parts"]
    return spelled.join(parts, ["row", "start"]).select(*columns).mapInArrow(run, "name long, row long, start long, alike long, bytes binary")


class SuffixFamily:
    """A logarithmic family of suffix arrays; each level is a written table with one row a shard.

    A new batch gets suffix arrays of its own. They are merge-scanned against every
    level: both arrays are walked in byte order, and what starts with the same
    ``length`` bytes on both sides is a match. Then the batch is a level itself, and levels of the
    same size are merged before the next one comes, so that n batches make about
    log(n) levels and each suffix is merged about log(n) times. Segments of one name are in
    the same shard of every level.
    """

    LEVEL = (
        "shard int, text binary, bounds array<int>, owner array<long>, at array<long>, suffixes array<int>, shared array<short>, "
        "runs array<struct<row: long, start: long, end: long>>"
    )

    def __init__(self, length: int, shards: int):
        self.length, self.shards = length, shards
        self.levels: list[tuple[int, DataFrame]] = []
        self.matched: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """batch: (name, row, start, bytes)."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, one), (m, two) = self.levels.pop(), self.levels.pop()
            self.levels.append((n + m, materialise(self._merged(two, one), "level")))
        length = self.length

        def build(table: pa.Table) -> pa.Table:
            array = SuffixArray.build(table["bytes"].to_pylist(), table["row"].to_numpy(), table["start"].to_numpy(), length)
            return _level(table["shard"][0].as_py(), array)

        placed = batch.select(F.pmod(F.xxhash64("name"), F.lit(self.shards)).cast("int").alias("shard"), "row", "start", "bytes")
        new = materialise(placed.groupBy("shard").applyInArrow(build, self.LEVEL), "level")
        self.matched += [new.select(F.inline("runs")), *(materialise(self._scanned(level, new), "matches") for _, level in self.levels)]
        self.levels.append((1, new))

    def _merged(self, one: DataFrame, two: DataFrame) -> DataFrame:
        length = self.length

        def merge(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return left if left.num_rows else right
            return _level(left["shard"][0].as_py(), _array(left, length).merge(_array(right, length)))

        return one.groupBy("shard").cogroup(two.groupBy("shard")).applyInArrow(merge, self.LEVEL)

    def _scanned(self, level: DataFrame, new: DataFrame) -> DataFrame:
        length = self.length

        def scan(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _run_table(*[np.empty(0, np.int64)] * 3)
            both = _array(left, length).merge(_array(right, length))
            return _run_table(*both.runs(both.repeated()))

        columns = ["shard", "text", "bounds", "owner", "at", "suffixes"]
        return level.select(*columns).groupBy("shard").cogroup(new.select(*columns).groupBy("shard")).applyInArrow(scan, "row long, start long, end long")

    def matches(self) -> DataFrame:
        """(row, start, end): runs of bytes covered by strings of length bytes that start in two places."""
        out = self.matched[0]
        for more in self.matched[1:]:
            out = out.union(more)
        return out


def _run_table(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    return pa.table({"row": row.astype(np.int64), "start": start.astype(np.int64), "end": end.astype(np.int64)})


def _level(shard: int, array: SuffixArray) -> pa.Table:
    runs = _run_table(*array.runs(array.repeated()))
    lists = [(array.bounds, np.int32), (array.owner, np.int64), (array.at, np.int64), (array.order, np.int32), (array.shared, np.int16)]
    cols = [pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), pa.array(x.astype(t))) for x, t in lists]
    structs = pa.StructArray.from_arrays([runs[c].combine_chunks() for c in runs.column_names], runs.column_names)
    cols.append(pa.ListArray.from_arrays(np.array([0, len(structs)], np.int32), structs))
    return pa.Table.from_arrays([pa.array([shard], pa.int32()), pa.array([array.text.tobytes()], pa.binary()), *cols], names=["shard", "text", "bounds", "owner", "at", "suffixes", "shared", "runs"])


def _array(level: pa.Table, length: int) -> SuffixArray:
    """A level's array; a merge works out anew what its suffixes share."""
    bounds, owner, at, order = (level[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("bounds", "owner", "at", "suffixes"))
    return SuffixArray(length, np.frombuffer(level["text"][0].as_py(), np.uint8), bounds, owner, at, order, np.zeros(len(order), np.int64))


def _wide_matches(rows: DataFrame, length: int) -> DataFrame:
    """Matches in segments of names that very many of them share: strings are counted over all tasks, by 128 bits of a BLAKE2."""

    def run(batches):
        for part in slices(batches, 64):
            row, start, codes = [], [], []
            for r, s, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                n = len(text) - length + 1
                row += [r] * n
                start += range(s, s + n)
                codes += [_digest(text[i : i + length]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(start, pa.int64()), pa.array(codes, pa.binary())], names=["row", "start", "string"])

    found = materialise(rows.select("row", "start", "bytes").mapInArrow(run, "row long, start long, string binary"), "strings")
    twice = materialise(found.groupBy("string").agg(F.count("*").alias("c")).where("c > 1").select("string"), "twice")
    return found.join(twice, "string").select("row", "start", (F.col("start") + length).alias("end"))


def repeated_spans(keyed: DataFrame, length: int = 200, gram: int = 32, batches: int = 4) -> DataFrame:
    """row, starts and ends (arrays, sorted) of the bytes covered by strings of ``length`` bytes that start elsewhere too.

    ``keyed`` has row (unique) and text. Segments whose name occurs once hold no repeated
    string. Of the others, those whose bytes occur again (by 128 bits of a BLAKE2) are repeated as a
    whole. Those that start alike but differ, where matches begin or end, go to a
    SuffixFamily, one segment of each kind, in ``batches`` batches, but for the parts that differ from all others in bytes that
    each of their strings holds; of a name that more than
    ALIKE kinds share, which would be one shard, the strings are counted over all tasks.
    """
    segmenter = Segmenter(length, gram)
    with intermediate(keyed.sparkSession) as keep:
        segments = materialise(_scan(keyed, segmenter), "segments")
        names = segments.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name")
        live = keep(materialise(segments.join(materialise(names, "names"), "name"), "live"))
    kind = ["name", "d1", "d2"]
    kinds = materialise(live.groupBy(*kind).agg(F.count("*").alias("times"), F.min(F.struct("row", "start", "n", "gap")).alias("o")), "kinds")
    counted = materialise(live.join(kinds.select(*kind, "times"), kind).select("row", "start", "n", "times"), "counted")  # a row for each live segment
    found = counted.where("times > 1").select("row", "start", (F.col("start") + F.col("n") - 1 + length).alias("end"))
    shared = materialise(kinds.groupBy("name").agg(F.count("*").alias("alike")).where("alike > 1"), "shared")
    at = F.struct("o.start", "o.n", "o.gap", "name", "alike")
    probes = materialise(kinds.join(shared, "name").select("o.row", at.alias("at")).groupBy("row").agg(F.collect_list("at").alias("at")), "probes")
    with intermediate(keyed.sparkSession) as keep:
        spelled = materialise(_spelled(_affected(keyed, probes)[0], probes, segmenter), "spelled")
        spelled = keep(materialise(_alike(spelled, length, segmenter.part), "alike"))
    some, many = spelled.where(F.col("alike") <= ALIKE), spelled.where(F.col("alike") > ALIKE)
    bytes_ = some.agg(F.sum(F.octet_length("bytes"))).first()[0]
    if bytes_:
        family = SuffixFamily(length, -(-bytes_ // SHARD))
        for i in range(batches):
            family.add(some.where(F.pmod(F.xxhash64("row", "start"), F.lit(batches)) == i))
        found = found.union(family.matches())
    if not many.isEmpty():
        found = found.union(_wide_matches(many, length))
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return found.select("row", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def _runs(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes from sorted spans; spans that touch are one run."""
    out: list[list[int]] = []
    for s, e in zip(starts, ends):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut_repeats(keyed: DataFrame, length: int = 200, gram: int = 32, with_text: bool = False) -> DataFrame:
    """As remove_repeats(), with row too: per row of keyed, which has row (unique), doc_id and text (not null)."""
    with intermediate(keyed.sparkSession) as keep:
        spans = materialise(repeated_spans(keyed, length, gram), "spans")
        hit, clear = _affected(keyed, spans)

        def cut(batches):
            for part in slices(batches):
                rows = []
                for row, doc_id, text, starts, ends in zip(*(part.column(i).to_pylist() for i in range(5))):
                    raw, runs = text.encode(), _runs(starts or [], ends or [])
                    kept, at = [], 0
                    for s, e in runs:
                        kept.append(raw[at:s])
                        at = e
                    left = b"".join([*kept, raw[at:]])
                    rows.append((row, doc_id, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore"), [list(r) for r in runs]))
                cols = [list(c) for c in zip(*rows)][: 8 if with_text else 6]
                kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))]
                names = ["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names[: len(cols)])

        schema = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string, spans array<array<long>>" * with_text
        columns = ["row", "doc_id", "text", "starts", "ends"]
        if clear is None:
            return keep(keyed.join(spans, "row", "left").select(*columns).mapInArrow(cut, schema))
        cut_rows = hit.join(spans, "row").select(*columns).mapInArrow(cut, schema)
        whole = clear.select(
            "row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
            *([F.col("text").alias("kept_text"), F.array().cast("array<array<bigint>>").alias("spans")] if with_text else []),
        )
        return keep(cut_rows.union(whole))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 32, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if with_text, kept_text and spans.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else in
    docs is removed, in all places where it occurs; strings don't cross documents
    and are judged on the input. kept_text drops bytes of characters that were cut
    through. A null or empty text has no bytes and nothing is removed. Rows are told apart by a number of
    their own: those that share a doc_id or have none are compared and cut as any other, and
    repeated rows of ``length`` bytes or more lose all their bytes. Texts of any
    length are read whole. Further columns don't matter; no rows give no rows.
    """
    with intermediate(docs.sparkSession) as keep:
        keyed = materialise(with_id_and_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "keyed")
        return keep(cut_repeats(keyed, length, gram, with_text).drop("row"))

"""Best-fit packing planned on the histogram of piece lengths."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.arrow import map_texts, with_id_and_text
from chronoweave.session import materialise

#: A length with more rows than this is ranked in several groups.
RANK_ROWS = 1024
#: Characters of a text that are encoded at once, up to the next space.
STRETCH = 1 << 16


# Fixed value: the published pattern of byte-level pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteWords:
    """Ids of a byte-level BPE tokenizer as little-endian unsigned 32-bit bytes.

    Byte-level pre-tokens never hold a space after a character that isn't white
    space, so that a text's ids are those of its words, each with the space before
    it. A text with white space before a space, or with a special token's string,
    is encoded whole by the library itself. Where ids follow the order of the merges,
    other texts are encoded by the same vocabulary as ranks, which takes a fraction of the
    time and gives the same ids. Else each distinct word is encoded once, in a table that is started anew at ``most`` words.
    """

    def __init__(self, path: str, most: int = 250_000):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]
        self.spaces = re.compile(r" (?<=\s )")
        self.word = self.ranked(spec) if self.by_word else None
        self.most = most
        self.anew()

    def anew(self) -> None:
        self.first: dict[str, bytes] = {"": b""}
        self.later: dict[str, bytes] = {}

    @staticmethod
    def ranked(spec: dict):
        """An encoder by ranks, or None where ids are not the order of the merges or words are cut otherwise."""
        model = spec["model"]
        vocab = {t: i for t, i in model["vocab"].items() if t not in {x["content"] for x in spec.get("added_tokens", [])}}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if odd or len(vocab) != 256 + len(merged) or any(vocab.get(m) != 256 + i for i, m in enumerate(merged)):
            return None
        import tiktoken

        byte = _bytes_of_characters()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def odd(self, text: str) -> bool:
        return not self.by_word or self.spaces.search(text) is not None or any(x in text for x in self.specials)

    def ranks(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            to = text.find(" ", at + STRETCH) if at + STRETCH < len(text) else -1
            to = len(text) if to < 0 else to
            out.append(array("I", self.word(text[at:to])).tobytes())
            at = to
        return b"".join(out)

    def table(self, texts: list[str]) -> list[bytes]:
        if len(self.later) > self.most:
            self.anew()
        split = [t.split(" ") for t in texts]
        firsts = list({w[0] for w in split}.difference(self.first))
        self.first.update(zip(firsts, self.raw(firsts)))
        new = list(set().union(*(w[1:] for w in split)).difference(self.later))
        self.later.update(zip(new, self.raw([" " + x for x in new])))
        return [self.first[w[0]] + b"".join(map(self.later.__getitem__, w[1:])) for w in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [self.odd(t) for t in texts]
        plain = [t for t, o in zip(texts, odd) if not o]
        whole, plain = iter(self.raw([t for t, o in zip(texts, odd) if o])), iter(map(self.ranks, plain) if self.word else self.table(plain))
        return [next(whole if o else plain) for o in odd]


@lru_cache(1)
def _byte_words(path: str) -> ByteWords:
    """A Python worker's vocabulary, which its next tasks take over."""
    return ByteWords(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each document's ids and then end_id, cut into pieces of at most size ids: doc_id, piece, start, length, ids_crc32[, ids].

    A document of at most size ids is one piece; of a longer one all pieces but the
    first have size ids. A null or empty text is the end_id alone. Rows repeat as
    they do in docs; a null doc_id stays null; further columns don't matter.
    """

    def make():
        words = _byte_words(tokenizer_path)
        words.anew()
        end = np.array([end_id], "<u4").tobytes()

        def work(doc_ids, texts):
            rows = []
            for doc_id, ids in zip(doc_ids, words.encode(texts)):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % size + 1
                for k, to in enumerate(range(first, n + 1, size)):
                    at = to - size if k else 0
                    rows.append((doc_id, k, at, to - at, zlib.crc32(part := ids[4 * at : 4 * to]), part))
            cols = list(zip(*rows))
            out = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(cols[5]), "<u4").astype(np.int32))
                out.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(cols[3])]).astype(np.int32), flat))
            return out

        return work

    fields = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    kinds = ["long", "int", "long", "long", "long"] + (["array<int>"] if with_ids else [])
    return map_texts(with_id_and_text(docs), make, ", ".join(map(" ".join, zip(fields, kinds))), fields)


def best_fit_plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank, n, sequence, stride, offset).

    Items rank .. rank + n - 1 of that length take the sequences sequence .. sequence
    + stride - 1 in turn, the first turn at offset and each further turn length
    later. Open sequences are kept as ranges with the same room left, so that the
    work and the plan depend on the lengths that occur, not on how many items have them.
    """
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if not ranges[room]:
                insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    rooms.pop(k)
            else:
                room, first = size, opened
                n = -(-left // (size // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, first, full, size - room))
                leave(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left and left < each:  # one more sequence takes what is left
                    plan.append((length, rank, left, first + full, 1, size - room))
                    leave(room - left * length, first + full, 1)
                    leave(room, first + full + 1, n - full - 1)
                    left = 0
                else:
                    leave(room, first + full, n - full)
    return plan


def place(pieces: DataFrame, size: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), rank_rows: int = RANK_ROWS) -> DataFrame:
    """Add sequence_id and offset to rows with lengths from 1 to size; sequences are filled without gaps from 0.

    ``pieces`` should be a written table: it is read for the histogram and again
    for the ranks. Only the histogram (at most size rows) goes to the driver and
    only the plan is broadcast; both are bounded by size, whatever the number of
    rows. A length that many rows share is ranked in salted groups of about
    rank_rows rows, whose counts are summed up before them. An empty table gives
    an empty result.
    """
    spark = pieces.sparkSession
    found = {r["n_"]: r["c_"] for r in pieces.groupBy(F.col(length).alias("n_")).agg(F.count("*").alias("c_")).collect()}
    plan = best_fit_plan(found, size)
    salts = spark.createDataFrame([(n, 1 + c // rank_rows) for n, c in found.items()], "l_ long, salts_ long")
    slots = spark.createDataFrame(plan, "l_ long, rank_ long, n_ long, seq_ long, stride_ long, off_ long")
    salted = (
        pieces.join(F.broadcast(salts), F.col(length) == F.col("l_"))
        .withColumn("salt_", F.pmod(F.xxhash64(*order), F.col("salts_")))
        .drop("salts_")
    )
    before = W.partitionBy("l_").orderBy("salt_").rowsBetween(W.unboundedPreceding, -1)
    base = (
        salted.groupBy("l_", "salt_").agg(F.count("*").alias("c_"))
        .select("l_", "salt_", F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("base_"))
    )
    tie = [c for c in pieces.columns if c not in order and dict(pieces.dtypes)[c] in ("bigint", "int", "string")]
    ranked = (
        salted.withColumn("r_", F.row_number().over(W.partitionBy("l_", "salt_").orderBy(*order, *tie)) - 1)
        .join(base, ["l_", "salt_"])
        .withColumn("r_", F.col("r_") + F.col("base_"))
    )
    turn = F.col("r_") - F.col("rank_")
    return (
        ranked.join(F.broadcast(slots.withColumnRenamed("l_", "p_")), (F.col("l_") == F.col("p_")) & (F.col("r_") >= F.col("rank_")) & (F.col("r_") < F.col("rank_") + F.col("n_")))
        .withColumn("sequence_id", F.col("seq_") + turn % F.col("stride_"))
        .withColumn("offset", F.col("off_") + F.expr("((r_ - rank_) div stride_) * l_"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenise docs (see token_pieces) and place the pieces (see place) in sequences of at most size ids."""
    return place(materialise(token_pieces(docs, tokenizer_path, size, with_ids=with_ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_ids and input_ids in order of place; packed must have ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("input_ids"))

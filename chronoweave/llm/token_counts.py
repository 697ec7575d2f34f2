"""Token counts of whole texts; huge documents are encoded in overlapping chunks that are spliced."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.arrow import map_texts, with_id_and_text
from chronoweave.llm.pieces import MARK, encode_words, inner_pairs, is_plain, load_model, marked_words, marks_never_inside


class PieceCounter:
    """Counts tokens as the sentencepiece library gives them, with memory bounded by a chunk.

    A text of more than ``chunk`` characters is encoded in chunks that overlap. Two
    neighbouring encodings are spliced at a position inside the overlap where both
    end a token and where the pair of characters is in no piece of the vocabulary,
    so that the whole text's encoding must end a token there too. If the overlap
    has no such position it is doubled; if a whole chunk has none, the chunk is.
    """

    def __init__(self, model_path: str, chunk: int = 16384, overlap: int = 128, most: int = 300_000):
        self.sp = sp = load_model(model_path)
        self.pairs = inner_pairs(sp)
        self.plain = is_plain(sp)
        self.by_word = self.plain and marks_never_inside(sp)
        self.chunk, self.overlap, self.most = chunk, overlap, most
        self.known: dict[str, int] = {}
        self.widened = 0
        pieces = range(sp.get_piece_size())
        value = [int(sp.id_to_piece(i)[1:-1], 16) if sp.is_byte(i) else -1 for i in pieces]
        self.inside = np.array([0x80 <= v < 0xC0 for v in value])  # byte pieces that don't begin a character
        self.width = np.array([(v < 0x80 or v >= 0xC0) if v >= 0 else 1 if sp.is_unknown(i) else len(sp.id_to_piece(i)) for i, v in enumerate(value)])

    def begins(self, text: str, at: int, to: int) -> np.ndarray:
        """Where the tokens of text[at:to] begin, as positions in the text."""
        ids = np.asarray(self.sp.encode(text[at:to]), dtype=np.int64)
        before = np.cumsum(self.width[ids]) - self.width[ids] - self.inside[ids]
        return at + np.maximum(before - 1, 0)  # the marker in front isn't in the text

    def proven(self, text: str, pos: int) -> bool:
        return text[pos - 1 : pos + 1].replace(" ", MARK) not in self.pairs

    def splice(self, text: str, low: int, left: np.ndarray, right: np.ndarray) -> int:
        """The last position above low that both encodings begin a token at and that is proven, or -1."""
        both = np.intersect1d(left[left > low], right)
        return next((int(p) for p in both[::-1] if self.proven(text, p)), -1)

    def long_count(self, text: str) -> int:
        n, total, start, at = len(text), 0, 0, 0
        to = min(n, self.chunk)
        left = self.begins(text, at, to)
        while to < n:
            overlap, pos = self.overlap, -1
            while pos < 0 and to - overlap > start:
                again = to - overlap
                end = min(n, again + max(self.chunk, 2 * overlap))
                right = self.begins(text, again, end)
                pos = self.splice(text, again, left, right)
                if pos < 0:
                    overlap, self.widened = overlap * 2, self.widened + 1
            if pos < 0:
                to = min(n, at + 2 * (to - at))
                left = self.begins(text, at, to)
                continue
            total += int(np.sum((left >= start) & (left < pos)))
            start, at, to, left = pos, again, end, right
        return total + int(np.sum(left >= start))

    def short_counts(self, texts: list[str]) -> list[int]:
        """Texts that need no splicing; where words can be segmented one by one, each is segmented once."""
        if not self.by_word:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)] if texts else []
        split = [marked_words(t) for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        new = list(set().union(*split).difference(self.known))
        self.known.update(zip(new, map(len, encode_words(self.sp, new))))
        return [sum(map(self.known.__getitem__, words)) for words in split]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.plain:
            return [len(self.sp.encode(t)) for t in texts]
        found = iter(self.short_counts([t for t in texts if len(t) <= self.chunk]))
        return [next(found) if len(t) <= self.chunk else self.long_count(t) for t in texts]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = 16384, overlap: int = 128) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs.

    A null or empty text has 0 bytes and 0 tokens; rows repeat as they do in the
    input; a null doc_id stays null; further columns of docs don't matter. No
    shuffle: each task reads its own rows, at most a chunk of a huge text at once.
    """

    def make():
        counter = PieceCounter(model_path, chunk, overlap)

        def work(ids, texts):
            return [pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.counts(texts), pa.int64())]

        return work

    out = map_texts(with_id_and_text(docs), make, "doc_id long, n_bytes long, n_tokens long", ["doc_id", "n_bytes", "n_tokens"])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweave.llm.arrow import map_texts, with_id_and_text
from chronoweave.llm.pieces import encode_words, is_plain, load_model, marked_words, marks_never_inside


class ChunkTable:
    """Segments each distinct marked word once and joins ids and decoded text back by position.

    Where no piece holds a marker after another character, no merge can reach over
    the start of a marked word, so that a text's ids are its words' ids in a row.
    The table is started anew at ``most`` words; that bounds memory and never
    changes a result. For a model without that property texts are encoded whole.
    """

    def __init__(self, model_path: str, most: int = 250_000):
        self.sp = load_model(model_path)
        self.by_chunk = is_plain(self.sp) and marks_never_inside(self.sp)
        self.most = most
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.names = [str(i) for i in range(self.sp.get_piece_size())]
        self.lead = self.sp.encode("a")
        self.n_lead = len(self.sp.decode(self.lead))

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.ids) > self.most:
            self.ids, self.decoded = {}, {}
        new = list(set().union(*texts).difference(self.ids))
        if new:
            found = encode_words(self.sp, new)
            name = self.names.__getitem__
            self.ids.update(zip(new, (",".join(map(name, x)) for x in found)))
            back = self.sp.decode([self.lead + x for x in found])
            self.decoded.update(zip(new, (x[self.n_lead :] for x in back)))

    def round_trips(self, texts: list[str]) -> list[tuple[str, str]]:
        """Of each text its decimal ids joined by commas, and what the library's decode() makes of them."""
        if not self.by_chunk:
            return [(",".join(map(str, x)), self.sp.decode(x)) for x in map(self.sp.encode, texts)]
        split = [marked_words(t) for t in texts]
        self.learn(split)
        return [(",".join(map(self.ids.__getitem__, w)), "".join(map(self.decoded.__getitem__, w))[1:]) for w in split]


def encode_pieces(docs: DataFrame, model_path: str, with_texts: bool = True, most: int = 250_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if with_texts, ids (decimal, joined by commas) and decoded.

    One row for each row of docs. A null or empty text has no ids and decodes to
    an empty text; a null doc_id stays null; further columns don't matter. The
    table of words lives in a task: a table of the whole corpus would have to
    shuffle every word, several times the input.
    """

    def make():
        table = ChunkTable(model_path, most)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def work(doc_ids, texts):
            both = table.round_trips(texts)
            ids, back = [x for x, _ in both], [x for _, x in both]
            out = [
                pa.array(doc_ids, pa.int64()),
                pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()),
                pa.array(map(digest, ids), pa.string()),
                pa.array(map(digest, back), pa.string()),
            ]
            return out + ([pa.array(ids, pa.string()), pa.array(back, pa.string())] if with_texts else [])

        return work

    fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_texts else [])
    kinds = ["long", "long", "string", "string"] + (["string", "string"] if with_texts else [])
    return map_texts(with_id_and_text(docs), make, ", ".join(map(" ".join, zip(fields, kinds))), fields)

"""Facts about a SentencePiece vocabulary that decide where a text may be cut."""

from __future__ import annotations

import re

MARK = "▁"


def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def vocabulary(sp) -> list[str]:
    """Pieces that cover text: no control, unknown or byte pieces."""
    n = sp.get_piece_size()
    return [sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def inner_pairs(sp) -> frozenset[str]:
    """All pairs of neighbouring characters inside a piece.

    Merges only build pieces of the vocabulary, so that no merge can ever bridge
    two characters whose pair is in none of them: a token always ends there.
    """
    return frozenset(p[i : i + 2] for p in vocabulary(sp) for i in range(len(p) - 1))


def marks_never_inside(sp) -> bool:
    """Whether a marker only follows markers, so that words can be segmented one by one."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p in vocabulary(sp))


def is_plain(sp) -> bool:
    """Whether the model only turns spaces to markers and adds one in front: no folding, no squeezing of spaces."""
    probes = ["a", " a", "a  b ", "ﬁＡ éé", "a\tb\r\nc　d", "  "]
    return all(sp.decode(sp.encode(p)) == p for p in probes) and sp.encode("a", out_type=str)[0].startswith(MARK)


_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def marked_words(text: str) -> list[str]:
    """A text's marked words in order: without its marker where there is just one, else with all markers."""
    if not text:
        return []
    if MARK not in text:
        words = text.split(" ")
        if "" not in words:
            return words
    return _WORD.findall(MARK + text.replace(" ", MARK))


def encode_words(sp, words: list[str]) -> list[list[int]]:
    """The ids of marked words, each on its own; the library itself puts the first marker."""
    alone = sp.piece_to_id(MARK)
    plain = [(w[1:] if w[0] == MARK else w).replace(MARK, " ") for w in words]
    return [x or [alone] for x in sp.encode(plain, num_threads=1)] if plain else []

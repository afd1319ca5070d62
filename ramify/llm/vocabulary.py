"""A fixed public vocabulary of text pieces, read once on the driver and sent to the executors."""

from __future__ import annotations

import math
from dataclasses import dataclass

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id ("" for control pieces), the ids of the 256 bytes, and integer scores."""

    pieces: tuple[str, ...]
    bytes: tuple[int, ...]
    scores: tuple[int, ...]

    @property
    def key(self) -> tuple:
        return (len(self.pieces), hash(self.pieces))


def load(model: str = MODEL, scale: int = 1024) -> Vocabulary:
    """The vocabulary of a SentencePiece model file.

    The file's scores are ranks of merges, so they are taken as ranks: a piece scores
    -scale * ln(rank), rounded, which is Zipf's law in whole numbers.
    """
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model)
    n = own.vocab_size()
    by_byte = [0] * 256
    pieces, scores = [], []
    for i in range(n):
        if own.is_byte(i):
            by_byte[int(own.id_to_piece(i)[3:5], 16)] = i
        special = own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i)
        pieces.append("" if special else own.id_to_piece(i))
        scores.append(-round(scale * math.log(i + 2)))
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece of this vocabulary crosses the start of a word")
    return Vocabulary(tuple(pieces), tuple(by_byte), tuple(scores))

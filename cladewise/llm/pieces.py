"""Vocabulary of a SentencePiece model and its pre-tokens, shared by the encoder and the counter."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"

#: A literal mark in a text is no space: it is written as bytes, so that decoding gives the text back.
MARK = "▁"
#: Pre-tokens: a run of spaces and what follows up to the next space. No piece crosses from a letter to a space.
PRE_TOKEN = re.compile(" *[^ ]+| +")


@dataclass
class Vocabulary:
    """Pieces with integer scores; a character that is no piece costs ``unknown`` and becomes bytes.

    ``endings`` has every ending of a piece, with the score of those that are
    pieces themselves: a text that is not in it ends no longer piece either.
    """

    score: dict[str, int]
    ids: dict[str, int]
    byte_ids: list[int]
    texts: list[bytes] = field(repr=False)
    unknown: int
    longest: int
    endings: dict[str, int | None] = field(repr=False)


def vocabulary(model_file: str = MODEL_FILE) -> Vocabulary:
    """Reads the model's pieces (a few ten thousand) on the driver; tasks get them by broadcast."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    score, ids, byte_ids, texts = {}, {}, [0] * 256, []
    for i in range(p.get_piece_size()):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif p.is_control(i) or p.is_unknown(i):
            texts.append(b"")
        else:
            piece = piece.replace(MARK, " ")
            score[piece], ids[piece] = round(p.get_score(i)), i
            texts.append(piece.encode())
    endings = {piece[k:]: None for piece in score for k in range(len(piece))} | score
    if any(" " in piece.lstrip(" ") for piece in score):
        raise ValueError("a piece of this model crosses from a letter to a space")
    return Vocabulary(score, ids, byte_ids, texts, min(score.values()) - 10, max(map(len, score)), endings)


def pre_tokens(text: str | None) -> list[str]:
    """Pre-tokens of a text with the space that the model puts before it; none of a null or empty text."""
    return PRE_TOKEN.findall(" " + text) if text else []

"""Pieces and scores of a public SentencePiece model, read on the driver: a fixed, small table.

Scores are those the file states; a unigram segmentation maximises their sum. Pieces hold an ordinary
space where the file has its visible one, so that a text's own U+2581 is never taken for a space.
"""

from __future__ import annotations

import os
from functools import lru_cache

VISIBLE_SPACE = "▁"


def default_model() -> str:
    return os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"


@lru_cache(maxsize=4)
def load(path: str) -> tuple[dict[str, tuple[int, float]], tuple[int, ...], float]:
    """({piece: (id, score)}, ids of the 256 bytes, score of an unknown character)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, of_byte = {}, [0] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            of_byte[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i).replace(VISIBLE_SPACE, " ")] = (i, model.get_score(i))
    # ten below the worst piece, as the public library scores an unknown character
    return pieces, tuple(of_byte), min(s for _, s in pieces.values()) - 10.0

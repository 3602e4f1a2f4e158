"""A public SentencePiece vocabulary as plain tables: pieces with scores, byte pieces, pre-tokens.

The model file is read on the driver (its size is checked) and travels with the tasks, so
executors need no copy of it.  Only models with identity normalisation and a dummy prefix are
taken: their encoding can be undone exactly.
"""

from __future__ import annotations

import re
from functools import cached_property

from stratus.llm.common import ship_by_value

ship_by_value(__name__)

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: a larger vocabulary is refused, as it travels with every task
MAX_PIECES = 1 << 18
SPACE = "▁"
#: below the lowest piece score, what a character outside the vocabulary costs
UNKNOWN_PENALTY = 10.0


class Pieces:
    """``score`` and ``ids`` by piece text, ``byte_ids`` for fallback, ``raw[id]`` the bytes an id stands for."""

    def __init__(self, score: dict[str, float], ids: dict[str, int], byte_ids: list[int], raw: list[bytes]):
        self.score, self.ids, self.byte_ids, self.raw = score, ids, byte_ids, raw
        self.longest = max(map(len, score))
        self.unknown = min(score.values()) - UNKNOWN_PENALTY

    @cached_property
    def splitter(self) -> re.Pattern:
        """Pre-tokens: a run of spaces with the word after it; what no piece holds stands alone.

        No piece has a space mark after another character, and none reaches over a character that
        no piece holds, so the best segmentation of a text is that of its pre-tokens in a row.
        """
        apart = "".join(c for c in "\n\t\r" if not any(c in p for p in self.score)) + SPACE
        return re.compile(f" +[^ {apart}]*|[^ {apart}]+|[{apart}]")

    def pre_tokens(self, text: str | None) -> list[str]:
        return self.splitter.findall(" " + text) if text else []

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]


def load_pieces(model_file: str = DEFAULT_MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = sp.get_piece_size()
    if size > MAX_PIECES:
        raise ValueError(f"{model_file} has {size} pieces; at most {MAX_PIECES} are taken")
    if sp.normalize("  a ｗ") != f"{SPACE * 3}a{SPACE}ｗ":
        raise ValueError(f"{model_file}: only identity normalisation with a dummy prefix is supported")
    score, ids, byte_ids, raw = {}, {}, [-1] * 256, []
    for i in range(size):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"{model_file}: piece {piece!r} reaches over a word's start")
            score[piece], ids[piece] = sp.get_score(i), i
            raw.append(piece.replace(SPACE, " ").encode())
    if -1 in byte_ids:
        raise ValueError(f"{model_file} has no byte fallback")
    return Pieces(score, ids, byte_ids, raw)

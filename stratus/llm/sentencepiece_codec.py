"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

Method: an automaton over all pieces reads a pre-token once; at each position its output links
name every piece that ends there, and each relaxes the best score of that position (single-pass
Viterbi).  A character that is no piece falls back to its UTF-8 bytes.  Decoding joins the bytes
of the ids.  Equal scores: the longer last piece wins.

Scale: a narrow map over the texts, no shuffle.  Pre-tokens repeat, so a task keeps the ids of
those it has met, up to ``CACHE_ENTRIES``; the result does not depend on it.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import add_columns, ship_by_value
from stratus.llm.pieces import DEFAULT_MODEL, SPACE, Pieces, load_pieces

ship_by_value(__name__)

CACHE_ENTRIES = 400_000
#: longer pre-tokens are not kept
CACHE_CHARS = 48


class Codec:
    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.score.items():
            self.automaton.add_word(piece, (len(piece), pieces.ids[piece], score))
        self.automaton.make_automaton()
        self.kept: dict[str, bytes] = {}

    def best_path(self, token: str) -> list[int]:
        """Ids of a pre-token (its spaces as they are in the text)."""
        if token == SPACE:  # the mark itself, not a space
            return self.pieces.fallback(token)
        marked = token.replace(" ", SPACE)
        n, score, unknown = len(marked), self.pieces.score, self.pieces.unknown
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        done = 0  # positions up to here have met their unknown character, if they have one

        def pass_unknown(upto: int) -> None:
            for i in range(done, upto):
                if marked[i] not in score and best[i] + unknown > best[i + 1]:
                    best[i + 1], back[i + 1] = best[i] + unknown, (i, -1)

        for end, (length, piece, value) in self.automaton.iter(marked):
            if end > done:
                pass_unknown(end)
                done = end
            start = end + 1 - length
            total = best[start] + value
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (start, piece)
        pass_unknown(n)
        ids: list[int] = []
        while n:
            start, piece = back[n]
            ids += [piece] if piece >= 0 else reversed(self.pieces.fallback(marked[start]))
            n = start
        return ids[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text (none for null or empty)."""
        found, kept = [], self.kept
        for token in self.pieces.pre_tokens(text):
            ids = kept.get(token)
            if ids is None:
                ids = array("i", self.best_path(token)).tobytes()
                if len(token) <= CACHE_CHARS:
                    if len(kept) >= CACHE_ENTRIES:
                        kept.clear()
                    kept[token] = ids
            found.append(ids)
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text that the ids stand for, without the space that encoding puts before it."""
        raw = b"".join(map(self.pieces.raw.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode_texts(docs: DataFrame, text_col: str = "text", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """``docs`` (all rows and columns) with ``piece_ids array<int>``, ``n_pieces`` and ``round_trip``.

    ``round_trip`` says whether decoding gives the text back exactly.  Null texts get null in all
    three, empty texts no ids.  Columns of these names in ``docs`` are replaced.
    """
    pieces = load_pieces(model_file)

    def make():
        codec = Codec(pieces)

        def fn(texts):
            ids = [codec.encode(t) for t in texts]
            null = np.array([t is None for t in texts])
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()), mask=pa.array(null))
            same = [None if t is None else codec.decode(i) == t for t, i in zip(texts, ids, strict=True)]
            return [lists, pa.array(np.diff(ends), pa.int32(), mask=null), same]

        return fn

    return add_columns(docs, text_col, make, "piece_ids array<int>, n_pieces int, round_trip boolean")


def decode_ids(encoded: DataFrame, ids_col: str = "piece_ids", out_col: str = "decoded", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` with ``out_col``: the text that the ids of each row stand for (null ids: null)."""
    pieces = load_pieces(model_file)

    @F.pandas_udf("string")
    def decoded(column):
        raw = pieces.raw
        return column.map(lambda ids: None if ids is None else b"".join(raw[i] for i in ids).removeprefix(b" ").decode("utf-8", "replace"))

    return encoded.withColumn(out_col, decoded(F.col(ids_col)))

"""Cross-tokenizer alignment: where the tokens of two public tokenizers end together.

Method: texts are shuffled by their full text, and each distinct text is tokenised by both
tokenizers and aligned once.  The byte offsets at which a token of A and a token of B both end cut
the text into groups; the pairs of tokens that end there are links.  How often two ids are linked
in the corpus is summed with each distinct text weighted by the number of documents that hold it,
and the measures are joined to the documents' ids.

Scale: tokens that end together share a suffix, so the pairs of ids that can be linked are known
from the two vocabularies alone.  Their table (some 100,000 rows, whatever the corpus) bounds what
a task sums, what reaches the driver and what travels with the second pass.  Texts move once, as
grouping keys with map-side combine; a text's links are kept as numbers of that table, and joins
use a 256-bit digest of the text on tables that Spark may split where one text is frequent.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import bound_batches, map_rows, shared_table, ship_by_value

ship_by_value(__name__)

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: a larger file is refused, as it travels with every task
MAX_FILE_BYTES = 64 << 20
#: rows that one call of both tokenizers gets
SLICE_ROWS = 64
SPACE = "▁"
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: texts that both encoders of A cut alike whatever their Unicode tables, and that are not one long pre-token
PLAIN = re.compile("[\x00-\u024f]{1,65536}")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1
    bytes stand for themselves, the others are numbered from 256 in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenizerPair:
    """Both tokenizers as bytes of their files, the bytes of every id, and the pairs of ids that can end together.

    ``pairs`` holds ``a * size_b + b``, sorted: all pairs of ids of which one's bytes end with the other's.
    """

    def __init__(self, file_a: str = TOKENIZER_A, file_b: str = TOKENIZER_B):
        import sentencepiece

        self.file_a, self.file_b = (self._read(f) for f in (file_a, file_b))
        vocabulary = json.loads(self.file_a)
        alphabet = byte_alphabet()
        special = {t["id"] for t in vocabulary["added_tokens"]}
        by_id = {i: t for t, i in vocabulary["model"]["vocab"].items()}
        self.raw_a = [bytes(alphabet[c] for c in by_id[i]) if i in by_id and i not in special else b"" for i in range(max(by_id) + 1)]
        sp = sentencepiece.SentencePieceProcessor(model_proto=self.file_b)
        self.raw_b = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            named = b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace(SPACE, " ").encode()
            self.raw_b.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else named)
        self.pairs = self._pairs()
        self.ranked = self._is_ranked(vocabulary)

    def _is_ranked(self, vocabulary: dict) -> bool:
        """Whether ids follow the order of merges, so that an encoder by rank gives the same tokens."""
        model, cut = vocabulary["model"], vocabulary.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get("".join(m), -1) for m in merges]
        alone = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        return bool(alone) and not vocabulary.get("normalizer") and ids == sorted(set(ids)) and len({r for r in self.raw_a if r}) == len(merges) + 256

    @staticmethod
    def _read(path: str) -> bytes:
        with open(path, "rb") as f:
            data = f.read(MAX_FILE_BYTES + 1)
        if len(data) > MAX_FILE_BYTES:
            raise ValueError(f"{path} has over {MAX_FILE_BYTES} bytes")
        return data

    def _pairs(self) -> np.ndarray:
        ids: tuple[dict[bytes, list[int]], dict[bytes, list[int]]] = ({}, {})
        for known, raw in zip(ids, (self.raw_a, self.raw_b), strict=True):
            for i, r in enumerate(raw):
                if r:
                    known.setdefault(r, []).append(i)
        found = set()
        for longer, shorter, swap in ((ids[0], ids[1], False), (ids[1], ids[0], True)):
            for raw, own in longer.items():
                for cut in range(len(raw)):
                    for other in shorter.get(raw[cut:], ()):
                        found.update((other, x) if swap else (x, other) for x in own)
        return np.array(sorted(a * len(self.raw_b) + b for a, b in found), dtype=np.int64)

    def aligner(self) -> Aligner:
        return Aligner(self)


class Aligner:
    """Both tokenizers loaded in a task; ``align(texts)`` gives the measures of each text."""

    def __init__(self, pair: TokenizerPair):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(pair.file_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.ranked = None
        if pair.ranked:
            import tiktoken

            ranks = {raw: i for i, raw in enumerate(pair.raw_a) if raw}
            self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pair.file_b)
        self.raw_a, self.raw_b, self.pairs = pair.raw_a, pair.raw_b, pair.pairs
        self.length_a, self.length_b = (np.array([len(r) for r in raw], dtype=np.int64) for raw in (self.raw_a, self.raw_b))
        # an id of A is followed by a comma or, at the end of a group, a bar; one of B by a comma or a semicolon
        self.marks = [f"{i}{mark}" for size, end in ((len(self.raw_a), "|"), (len(self.raw_b), ";")) for mark in (",", end) for i in range(size)]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        plain = [self.ranked is not None and PLAIN.fullmatch(t) is not None for t in texts]
        others = iter(self.a.encode_batch_fast([" " + t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        in_a = (self.ranked.encode_ordinary(" " + t) if p else next(others).ids for t, p in zip(texts, plain, strict=True))
        return zip(in_a, self.b.encode(texts, num_threads=1), strict=True)

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, bytes]]:
        """``(n_a, n_b, n_groups, groups_sha256, links)``; ``links`` holds 32-bit places in ``pairs``."""
        whole = [t for t in texts if t]
        encoded = self.encode(whole)
        return [self._one(t, *next(encoded)) if t else (0, 0, 0, "", b"") for t in texts]

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``a`` and in ``b`` of the tokens that end together."""
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at = np.searchsorted(end_b, end_a)  # no token is empty, so ends grow; both sum up to the text's bytes
        last_a = np.flatnonzero(end_b[at] == end_a)
        return last_a, at[last_a]

    def _one(self, text: str, a_ids: list[int], b_ids: list[int]) -> tuple[int, int, int, str, bytes]:
        want = (" " + text).encode()
        raw_a, raw_b = self.raw_a, self.raw_b
        if b"".join([raw_a[i] for i in a_ids]) != want or b"".join([raw_b[i] for i in b_ids]) != want:
            return 0, 0, 0, "", b""
        a, b = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
        last_a, last_b = self.groups(a, b)
        # where each token's text stands: A's tokens of a group, then B's
        before_a, before_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        before_a[last_a[:-1] + 1], before_b[0] = np.diff(last_b, prepend=-1)[:-1], last_a[0] + 1
        before_b[last_b[:-1] + 1] = np.diff(last_a)
        ends_a, ends_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        ends_a[last_a], ends_b[last_b] = True, True
        names = np.empty(len(a) + len(b), dtype=np.int64)
        names[np.arange(len(a)) + np.cumsum(before_a)] = a + ends_a * len(raw_a)
        names[np.arange(len(b)) + np.cumsum(before_b)] = b + ends_b * len(raw_b) + 2 * len(raw_a)
        marks = self.marks
        line = "".join([marks[i] for i in names.tolist()])[:-1]
        links = np.searchsorted(self.pairs, a[last_a] * len(raw_b) + b[last_b]).astype(np.int32)
        return len(a), len(b), len(last_a), hashlib.sha256(line.encode()).hexdigest(), links.tobytes()


def align_texts(texts: DataFrame, pair: TokenizerPair) -> DataFrame:
    """``(text_key, n_docs, text)`` of distinct texts -> ``(text_key, n_docs, n_a, n_b, n_groups, groups_sha256, links)``."""

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        aligner = pair.aligner()
        return lambda c: [c[0], c[1], *map(list, zip(*aligner.align(c[2]), strict=True))]

    schema = "text_key binary, n_docs long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
    return map_rows(texts.select("text_key", "n_docs", "text"), make, schema, SLICE_ROWS)


def pair_counts(aligned: DataFrame, size: int) -> DataFrame:
    """``(pair, n)``: how many links of the corpus hold the pair, copies of a text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for n, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places, times = np.unique(np.frombuffer(links, dtype=np.int32), return_counts=True)
                total[places] += n * times
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], names=["pair", "n"])

    return bound_batches(aligned.select("n_docs", "links")).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair: TokenizerPair | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs``.

    ``n_best`` counts the links whose pair is the most frequent one of its B id (ties included) and
    ``count_sum`` adds up their pairs' corpus counts.  A text that is null, empty, or not given back byte
    for byte by both tokenizers has no tokens: zeros and an empty digest.  Rows that repeat count as
    often as they stand; a null id stays null.  Other columns are not looked at; no rows give no rows.
    """
    pair = pair or TokenizerPair()
    text = F.col(f"`{text_col}`").cast("string")
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_key")  # null and empty texts measure alike
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("n_docs"))
    aligned = shared_table(align_texts(distinct.select(key, "n_docs", "text"), pair), "aligned")
    size, width = len(pair.pairs), len(pair.raw_b)
    counted = pair_counts(aligned, size).toArrow()  # a row per pair of ids at most
    counts = np.zeros(size, dtype=np.int64)
    counts[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    highest = np.zeros(width, dtype=np.int64)
    np.maximum.at(highest, pair.pairs % width, counts)
    best = counts == highest[pair.pairs % width]

    def measure(c):
        links = [np.frombuffer(x, dtype=np.int32) for x in c[5]]
        return [*c[:5], [len(x) for x in links], [int(best[x].sum()) for x in links], [int(counts[x].sum()) for x in links]]

    names = ["n_a", "n_b", "n_groups", "groups_sha256"]
    schema = "text_key binary, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    measures = shared_table(map_rows(aligned.select("text_key", *names, "links"), lambda: measure, schema), "measures")
    joined = rows.select("doc_id", key).join(measures, "text_key", "left")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return joined.select("doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))

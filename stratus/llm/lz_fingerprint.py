"""Document fingerprints from Lempel-Ziv phrases.

Method: a text is parsed from left to right into dictionary phrases (LZ78: the shortest run not
seen before is the next phrase).  The set of phrases is hashed, and its ``SKETCH`` smallest hashes
are the fingerprint.  The likeness of two fingerprints estimates the Jaccard similarity of the
phrase sets (bottom-k minimum hashing), a compression-like similarity; it is exact for sets no
larger than the sketch.

Scale: each text moves once, to the chunk of its id's range.  A chunk also gets the first document
of the next one, so neighbours in id order meet without a global window.  Tasks stream their rows;
the two texts of a document share the parse of what they have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import MOST_CHUNKS, SLICE_ROWS, bound_batches, chunk_count, map_rows, ship_by_value

ship_by_value(__name__)

SKETCH = 128


def parse(text: str, phrases: set[str], begin: int, at: int) -> int:
    """Go on parsing at ``at``, where ``text[begin:at]`` is the phrase begun.  Adds the phrases found;
    returns where the last phrase, which is in the set or empty, begins."""
    for end in range(at + 1, len(text) + 1):
        phrase = text[begin:end]
        if phrase not in phrases:
            phrases.add(phrase)
            begin = end
    return begin


def hashes(phrases: set[str]) -> np.ndarray:
    digest = xxhash.xxh32_intdigest
    return np.fromiter((digest(p) for p in phrases), np.uint32, len(phrases))


def smallest(values: np.ndarray, sketch: int) -> np.ndarray:
    return np.unique(values)[:sketch]


def sketch_of(text: str, sketch: int = SKETCH) -> np.ndarray:
    phrases: set[str] = set()
    parse(text, phrases, 0, 0)
    return smallest(hashes(phrases), sketch)


def likeness(a: np.ndarray, b: np.ndarray, sketch: int = SKETCH) -> float:
    """Estimated Jaccard similarity of the phrase sets; 1 for two empty texts, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.unique(np.concatenate([a, b]))[:sketch]  # the smallest hashes of both sets together
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(common, union[-1], side="right")) / len(union)


def to_string(sketch: np.ndarray) -> str:
    """Eight hex digits for each minimum hash, in ascending order."""
    return sketch.astype(">u4").tobytes().hex()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: int = SKETCH) -> DataFrame:
    """``(doc_id, fingerprint)`` for every row; a null text counts as empty (fingerprint ``""``)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_rows(rows, lambda: lambda c: [c[0], [to_string(sketch_of(t, sketch)) for t in c[1]]], "doc_id long, fingerprint string")


class _Open:
    """A document whose successor is not known yet."""

    def __init__(self, doc_id: int | None, text: str, sketch: int):
        self.doc_id, self.text, self.size = doc_id, text, sketch
        self.tail = len(text) // 4
        cut = len(text) - self.tail
        self.head = text[:cut]
        self.phrases: set[str] = set()
        self.begin = parse(self.head, self.phrases, 0, 0)
        self.head_hashes = hashes(self.phrases)
        self.sketch = self.with_tail(text)

    def with_tail(self, text: str) -> np.ndarray:
        """Sketch of a text that begins as this document's head."""
        known = self.phrases
        added = known.copy()
        parse(text, added, self.begin, len(self.head))
        return smallest(np.concatenate([self.head_hashes, hashes(added - known)]), self.size)

    def row(self, following: str, next_sketch: np.ndarray) -> tuple:
        edited = self.head + following[: self.tail]
        sketch = self.with_tail(edited)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        own = (self.doc_id, len(self.text), digest, to_string(self.sketch), to_string(sketch))
        return (*own, likeness(self.sketch, sketch, self.size), likeness(self.sketch, next_sketch, self.size))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: int = SKETCH) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per row.

    The edited text has its last quarter (rounded down, code points) replaced by the first as many
    code points (or all) of the next document in ascending id; the first follows the last.  Rows
    with equal ids are in order of their text; a null id comes first.  A null text counts as empty.
    Other columns are not looked at.  No rows give no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    chunks = min(MOST_CHUNKS, chunk_count(rows, "text"))  # tasks stream their rows, so a larger chunk needs no more memory
    ids = rows.select("key").distinct().repartitionByRange(chunks, "key")
    firsts = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("first")).select("first").collect()  # one number per chunk, MOST_CHUNKS at most
    bounds = np.array(sorted(r[0] for r in firsts), dtype=np.int64)
    last = len(bounds) - 1

    @F.pandas_udf("array<long>")
    def chunks_of(keys):
        """Twice the chunk of a row; for a chunk's first id also twice the chunk before, plus one."""
        chunk = np.searchsorted(bounds, keys.to_numpy(), side="right") - 1
        is_first = bounds[chunk] == keys.to_numpy()
        out = [[2 * c, 2 * (c - 1 if c else last) + 1] if f else [2 * c] for c, f in zip(chunk.tolist(), is_first, strict=True)]
        return pd.Series(out, index=keys.index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunk, out = None, None, []
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def pack() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for code, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(start, SLICE_ROWS).columns), strict=True):
                    if code >> 1 != chunk:
                        held, chunk = None, code >> 1
                    if code & 1 and held is None:
                        continue  # only the first of the next chunk's first rows follows
                    new = None if code & 1 else _Open(doc_id, text, sketch)
                    if held is not None:
                        out.append(held.row(text, sketch_of(text, sketch) if new is None else new.sketch))
                    held = new
                if out:
                    yield pack()

    placed = rows.select(F.explode(chunks_of("key")).alias("code"), "doc_id", "key", "text").withColumn("chunk", F.shiftright("code", 1))
    ordered = placed.repartition(max(1, chunks), "chunk").sortWithinPartitions("code", "key", "text")
    return bound_batches(ordered.select("code", "doc_id", "text")).mapInArrow(run, schema)

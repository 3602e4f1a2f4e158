"""Substring dedup by hashing the units of lines or paragraphs.

Method: texts are cut into units (sentences inside lines, whole lines, or paragraphs between blank
lines).  A unit is normalised (lower case, runs of ASCII white space as one space, ends trimmed)
and digested (128 bits).  Digests are grouped over all documents; the occurrence with the lowest rank
(document id, then position) stays.  Adjacent later occurrences in a document whose first occurrences
follow one another likewise make a passage, and every passage of ``min_words`` words or more is removed.  The original offsets of what is removed, and
where each unit stays, are the result; texts are rebuilt from it.

The minimum belongs to the passage, not to the unit, so that a repeated passage goes with its short
sentences while a lone stock line stays.  Scripts without spaces count two characters as a word.
With ``min_words=1`` every later occurrence goes.

Scale: one pass over the texts gives a narrow table of units.  Grouping it pre-aggregates, and
the join that follows is an equi-join that Spark may split where one digest is frequent.  Passages
are put together per document.  The texts themselves move once, to be rebuilt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.llm.common import map_rows, shared_table, ship_by_value

ship_by_value(__name__)

#: shorter passages are common by chance and stay
MIN_WORDS = 20
BLANK = " \t\r\f\v\n"
#: where a unit ends, with the white space after it
SEPARATOR = {
    "sentence": re.compile(r"[.!?…؟।][ \t]+|\n[ \t\r\f\v]*|[。！？]+[ \t]*"),
    "line": re.compile(r"\n"),
    "paragraph": re.compile(r"\n[ \t\r\f\v]*\n\s*"),
}
#: kana, Han, Thai, Lao, Burmese and Khmer letters stand without spaces; two of them count as a word
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")


def count_words(norm: str) -> int:
    """Words of a normalised unit."""
    alone = 0 if norm.isascii() else len(SPACELESS.findall(norm))
    return len(SPACELESS.sub(" ", norm).split()) + (alone + 1) // 2 if alone else norm.count(" ") + 1


def spans_of(text: str, unit: str) -> Iterator[tuple[int, int, str]]:
    """Start, end (code points) and normalised text of every unit that has a word, in order."""
    start = 0
    for end in [*(m.end() for m in SEPARATOR[unit].finditer(text)), len(text)]:
        piece = text[start:end].rstrip(BLANK)
        norm = b" ".join(piece.lower().encode().split()).decode()
        if norm:
            yield start, start + len(piece), norm
        start = end


def units_of(docs: DataFrame, id_col: str, text_col: str, unit: str) -> DataFrame:
    """``(doc_id, text_key, unit, start, end, n_words, digest)`` for units that have a word, numbered from 0."""

    def cut(columns):
        out: list[list] = [[] for _ in range(7)]
        for doc_id, key, text in zip(*columns, strict=True):
            for number, (start, end, norm) in enumerate(spans_of(text, unit)):
                row = (doc_id, key, number, start, end, count_words(norm), xxhash.xxh3_128_digest(norm.encode()))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        return out

    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return map_rows(rows, lambda: cut, "doc_id long, text_key long, unit int, start int, end int, n_words int, digest binary")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per unit to remove: ``doc_id, unit, start, end, n_words, kept_doc_id, kept_unit, kept_start, passage,
    passage_words, text_key``.

    ``start`` and ``end`` are code points of the original text, ``kept_*`` name the occurrence
    that stays, ``passage`` is the first unit of the passage that the unit is in.  Rows with
    the same id and text are one document; a null id ranks last.  Null, empty and wordless texts, and passages
    under ``min_words`` words, give no rows.  Other columns are not looked at.
    """
    units = shared_table(units_of(docs, id_col, text_col, unit), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "unit", "text_key", "start")
    # a table of its own, so that the join below may split a frequent digest
    first = shared_table(units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    later = units.join(first, "digest").where(rank != F.col("first"))
    kept = [F.col(f"first.{c}").alias(f"kept_{c}") for c in ("doc_id", "unit", "start", "text_key")]
    later = later.select("doc_id", "unit", "start", "end", "n_words", *kept, "text_key")
    # all windows below are of one document, less where rows repeat id and text
    own = Window.partitionBy("doc_id", "text_key").orderBy("unit")
    once = later.withColumn("before", F.lag("unit").over(own)).where("before is null or before <> unit")
    source = ["doc_id", "text_key", "kept_doc_id", "kept_text_key", "shift"]
    run = once.withColumn("shift", F.col("kept_unit") - F.col("unit")).withColumn("run", F.col("unit") - F.row_number().over(Window.partitionBy(*source).orderBy("unit")))
    passage = Window.partitionBy(*source, "run")
    summed = run.withColumn("passage", F.min("unit").over(passage)).withColumn("passage_words", F.sum("n_words").over(passage))
    columns = ["doc_id", "unit", "start", "end", "n_words", "kept_doc_id", "kept_unit", "kept_start", "passage", "passage_words", "text_key"]
    return summed.where(F.col("passage_words") >= min_words).select(*columns)


def without_units(text: str, unit: str, lost: set[int]) -> str:
    """``text`` less the units ``lost``; of the gaps around them the one with most line ends stays."""
    out, gap, end = [], None, 0
    for number, (start, stop, _) in enumerate(spans_of(text, unit)):
        between = text[end:start]
        gap = between if gap is None or between.count("\n") > gap.count("\n") else gap
        if number not in lost:
            out += [gap, text[start:stop]] if out else [text[start:stop] if end else text[:stop]]
            gap = None
        end = stop
    return "".join(out) + (text[end:] if gap is None else "")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated passages; a document that loses all its text goes.

    A column ``n_chars`` is set anew where a text changes.  Documents that lose nothing stay as
    they are, null and empty texts included.
    """
    spans = repeated_spans(docs, id_col, text_col, unit, min_words)
    # a document's list is no longer than its text
    gone = spans.groupBy("doc_id", "text_key").agg(F.collect_list("unit").alias("gone units"))
    gone = shared_table(gone, "gone").withColumnsRenamed({"doc_id": "gone id", "text_key": "gone key"})
    text = F.col(f"`{text_col}`")
    joined = docs.join(gone, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("gone id")) & (F.xxhash64(text.cast("string")) == F.col("gone key")), "left")

    @F.pandas_udf("string")
    def rest(texts, units):
        def one(whole, lost):
            return whole if lost is None or whole is None else without_units(whole, unit, set(lost))

        return texts.combine(units, one)

    rest = rest.asNondeterministic()  # else the filter below would have it computed a second time
    # one pass over the joined rows, as the texts are moved for it; those that lose nothing are not handed to Python
    changes = F.col("`gone units`").isNotNull()
    cut = joined.withColumn("rest of text", rest(F.when(changes, text.cast("string")), F.when(changes, F.col("`gone units`"))))
    cut = cut.where(~changes | (F.length(F.trim("rest of text")) > 0))
    types = dict(docs.dtypes)

    def column(name: str):
        old = F.col(f"`{name}`")
        if name == text_col:
            return F.when(changes, F.col("`rest of text`")).otherwise(old).alias(name)
        if name == "n_chars":
            return F.when(changes, F.length("rest of text").cast(types[name])).otherwise(old).alias(name)
        return old

    return cut.select(*[column(c) for c in docs.columns])

"""Source divergence audit: how the words of a language's sources differ.

Method: a translate table lowers letters and blanks every separator byte in one pass over the
UTF-8 bytes of a text, ``bytes.split`` cuts the words, and a ``Counter`` per document yields its
frequencies.  They are summed sparsely: only words that occur in a source have a row, and what the
words that occur in neither of two sources add to their divergence is one product.

All arithmetic is exact.  With N the occurrences of kept terms in a group and V their number, a
term's share is ``p = 1 + floor(scale * (count + 2) / (N + 2 V))`` and two shares differ by
``f = floor((p - q)^2 / (p + q))``, which is symmetric.

Scale: the pass over the texts adds up the counters of a slice before Spark sums them, with
map-side combine, so a frequent word or a large source is one row per slice.  Pairs of sources are
compared in tiles of sources and blocks of terms; a task holds one small dense block, emits one sum
per pair of its tiles, and no join makes pairs.  Top terms are ranked under a limit that Spark
applies before the shuffle.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.llm.common import map_rows, shared_table, ship_by_value

ship_by_value(__name__)

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP_TERMS = 10
#: sources compared in one task with as many others, and the kept terms of a block
TILE_SOURCES = 64
BLOCK_TERMS = 4096
#: a document's text as seen by ``split``: letters in lower case, bytes above ASCII as they are, all else blank
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term (UTF-8) of a text; a null text has none."""
    return Counter(text.encode("utf-8", "surrogatepass").translate(TABLE).split()) if text else Counter()


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, n_docs)``: occurrences of a term in a group, and documents (rows) that hold it.

    Null languages, sources and texts are read as empty.
    """

    def count(columns):
        terms, holders = defaultdict(Counter), defaultdict(Counter)
        for lang, source, text in zip(*columns, strict=True):
            own = term_counts(text)
            terms[lang, source].update(own)
            holders[lang, source].update(own.keys())
        out: list[list] = [[] for _ in range(5)]
        for (lang, source), counter in terms.items():
            held = holders[lang, source]
            for column, values in zip(out, ([lang] * len(counter), [source] * len(counter), [t.decode() for t in counter], counter.values(), [held[t] for t in counter]), strict=True):
                column.extend(values)
        return out

    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = map_rows(rows, lambda: count, "lang string, source string, term string, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _share(n: str, total: str, kept: str) -> str:
    """SQL of ``1 + floor(SCALE * (n + 2) / (total + 2 kept))``, in decimals that hold the product of any count."""
    return f"(1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 2 as decimal(20, 0))) div cast({total} + 2 * {kept} as decimal(20, 0)))"


def _distance(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


class Shares:
    """The tables of an audit, written to the shared folder.

    ``terms``: ``(lang, source, term, p, q)`` of the kept terms that occur in a group, with the shares
    in the group and in the language; ``groups``: ``(lang, source, rest, kept)`` of every group, with
    the share of a kept term that it lacks (NULL where none is kept) and the number of kept terms.
    """

    def __init__(self, docs: DataFrame, lang_col: str, source_col: str, text_col: str, min_docs: int):
        names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
        counts = shared_table(count_terms(docs, lang_col, source_col, text_col), "term-counts")
        by_term = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("lang_n"))
        kept = shared_table(by_term.where(F.col("n_docs") >= min_docs).select("lang", "term", "lang_n"), "kept-terms")
        langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
        found = shared_table(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "group-terms")
        totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = docs.select(*names).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), "lang_total")
        sized = shared_table(groups.withColumn("rest", F.expr(f"if(kept > 0, {_share('0', 'total', 'kept')}, null)")), "groups")
        self.groups = sized.select("lang", "source", "rest", "kept")
        p, q = _share("n", "total", "kept"), _share("lang_n", "lang_total", "kept")
        self.terms = found.join(sized, ["lang", "source"]).select("lang", "source", "term", F.expr(p).alias("p"), F.expr(q).alias("q"))


def top_terms(shares: Shares, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, item, value, rank)``: the terms a group has more of than its language, most apart first."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = shares.terms.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_distance("p", "q")).alias("value"))
    return over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _tiles(shares: Shares, tile_sources: int, block_terms: int) -> DataFrame:
    """``(lang, low, high, block, left, right, source, rest, cell, p)``: for each pair of tiles and block of terms
    the shares of the sources in them; every source has one more row, without ``cell``, in each of its blocks.

    ``left`` and ``right`` tell on which side of its pair of tiles a source stands (both in a tile's own pair)."""
    per_lang = shares.groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("kept").alias("most"))
    cuts = per_lang.select(
        "lang",
        F.ceil(F.col("sources") / tile_sources).cast("int").alias("tiles"),
        F.greatest(F.lit(1), F.ceil(F.col("most") / block_terms)).cast("int").alias("blocks"),
    )
    dealt = shares.groups.join(cuts, "lang").withColumn("tile", F.expr("cast(pmod(xxhash64(source), tiles) as int)"))
    here = ["lang", "source", "rest", "tile", "tiles", "blocks"]
    heads = dealt.select(*here, F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(None).cast("string").alias("cell"), F.lit(None).cast("long").alias("p"))
    cells = shares.terms.join(dealt, ["lang", "source"]).select(*here, F.expr("cast(pmod(xxhash64(term), blocks) as int)").alias("block"), F.col("term").alias("cell"), "p")
    placed = heads.unionByName(cells).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    pair = [F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")]
    return placed.select("lang", *pair, "block", (F.col("tile") <= F.col("other")).alias("left"), (F.col("tile") >= F.col("other")).alias("right"), "source", "rest", "cell", "p")


def _compare(table: pa.Table) -> pa.Table:
    """Sums of distances over the terms of one block, for each pair of sources (left before right) of one pair of tiles."""
    lang = table.column("lang")[0].as_py()
    source, cell = table.column("source").to_pylist(), table.column("cell")
    heads = np.flatnonzero(cell.is_null().to_numpy())
    names = [source[i] for i in heads]
    place = {name: i for i, name in enumerate(names)}
    rest, left, right = (table.column(c).to_numpy()[heads] for c in ("rest", "left", "right"))
    cells = np.flatnonzero(cell.is_valid().to_numpy())
    terms, column = np.unique(np.array(cell.take(cells).to_pylist(), dtype=object), return_inverse=True) if len(cells) else ([], [])
    shares = np.repeat(np.nan_to_num(rest).astype(np.int64)[:, None], len(terms), axis=1)
    if len(cells):
        shares[[place[source[i]] for i in cells], column] = table.column("p").to_numpy()[cells].astype(np.int64)
    out: list[list] = [[] for _ in range(6)]
    for i in np.flatnonzero(left):
        others = [j for j in np.flatnonzero(right) if j != i and (not left[j] or not right[i] or names[i] < names[j])]
        if others:
            gap, both = shares[others] - shares[i], shares[others] + shares[i]
            sums = (gap * gap // np.maximum(both, 1)).sum(1)
            kept = [None if np.isnan(x) else int(x) for x in rest[[i, *others]].astype(float)]
            for values, new in zip(out, ([names[i]] * len(others), [names[j] for j in others], sums.tolist(), [len(terms)] * len(others), [kept[0]] * len(others), kept[1:]), strict=True):
                values.extend(new)
    arrays = [pa.array([lang] * len(out[0]), pa.string()), *[pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]]
    return pa.table(arrays, names=["lang", "a", "b", "part", "seen", "a_rest", "b_rest"])


def source_pairs(shares: Shares, tile_sources: int = TILE_SOURCES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(lang, source, item, value, rank)``: every other source of the language, the most divergent first."""
    schema = "lang string, a string, b string, part long, seen long, a_rest long, b_rest long"
    tiles = _tiles(shares, tile_sources, block_terms)
    parts = tiles.groupBy("lang", "low", "high", "block").applyInArrow(_compare, schema)
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"), F.max("a_rest").alias("a_rest"), F.max("b_rest").alias("b_rest"))
    kept = shares.groups.groupBy("lang").agg(F.max("kept").alias("kept"))
    # terms that no source of the two tiles has: the same distance for each of them
    value = F.expr(f"if(kept > 0, part + (kept - seen) * {_distance('a_rest', 'b_rest')}, 0)")
    pairs = sums.join(kept, "lang").select("lang", "a", "b", value.alias("value"))
    both = pairs.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.withColumn("rank", F.row_number().over(order))


def audit_sources(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of both reports (part ``pair`` and part ``term``).

    Null languages, sources and texts are read as empty, so they make groups of their own; repeated rows
    count as often as they stand.  A group without kept terms has its pairs, and a language without
    kept terms has them with value 0.  A language of one source has no pairs; no rows give no rows.
    Ties are in the order of the item's UTF-8 bytes.  Other columns are not looked at.
    """
    shares = Shares(docs, lang_col, source_col, text_col, min_docs)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_pairs(shares).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(top_terms(shares, top).withColumn("part", F.lit("term")).select(*columns))

"""SimHash near-dedup with a Gray-order hierarchical index.

Method: every document gets a 64-bit fingerprint of its word shingles.  Distinct fingerprints
are indexed in a hierarchy of shared masked bit patterns.  Its upper nodes are exact blocks of
bits: two fingerprints with at most ``max_bits`` differing bits agree on at least one of
``max_bits + 1`` blocks, so each block value is a node that tasks can own.  A node with more
than ``node_limit`` members is split by the blocks of its remaining bits.  Inside a node the
members are sorted by Gray rank and cut into a tree; every tree node holds the bits on which
all its members agree, less those its parent holds already.  A search adds up the differences
on the way down and drops a whole group once they pass ``max_bits``.

Scale: one pass over the texts; after it only distinct fingerprints move.  A task emits a
spanning forest of the links it finds (never all pairs), and the components are found by
:mod:`stratus.llm.components`.  Copies of a text meet in one row before any search.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import map_rows, shared_table, ship_by_value
from stratus.llm.components import component_roots

ship_by_value(__name__)

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: a node of the index with more members is split by further blocks of bits
NODE_LIMIT = 8192
#: node and query pairs that a task looks at together
FRONTIER = 1 << 21
FANOUT = 8
LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have bit 0, 1, ... 63 set."""
    counts = np.zeros((8, 8), dtype=np.int64)
    starts = np.arange(0, len(hashes), 255)  # a byte lane holds up to 255
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, starts)
        counts[:, shift] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return counts.ravel()


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of a text.  A-Z are lower-cased, words end at ASCII white space; a
    text with fewer words than a shingle is one shingle; without words (or null) it is zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        value = xxhash.xxh64_intdigest(joined, SEED)
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: len(words) - shingle]]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], dtype=np.uint64)
        bits = bit_counts(hashes) * 2 > len(hashes)
        value = int(np.packbits(bits, bitorder="little").view(np.uint64)[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` per row; ``fp`` is a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, lambda: lambda c: [c[0], [fingerprint(t, shingle) for t in c[1]]], "doc_id long, fp long")


def _blocks(bits: list[int], max_bits: int) -> list[list[int]]:
    return [list(map(int, b)) for b in np.array_split(np.array(bits), max_bits + 1) if len(b)]


def _block_value(fp: Column, bits: list[int]) -> Column:
    """The bits ``bits[0] .. bits[-1]`` (consecutive) of ``fp`` as a number."""
    return F.shiftrightunsigned(fp, bits[0]).bitwiseAND(F.lit((1 << len(bits)) - 1))


def index_nodes(classes: DataFrame, max_bits: int = MAX_BITS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Distinct fingerprints -> ``(node, part, fp)``: the members of every upper node.

    ``node`` names the exact blocks; ``part`` is empty but for nodes that stay larger than
    ``node_limit`` after two levels: those are cut into segments, and each pair of segments is a part.
    """
    top = _blocks(list(range(64)), max_bits)
    first = F.explode(F.array(*[F.concat_ws(":", F.lit(i), _block_value(F.col("fp"), b).cast("string")) for i, b in enumerate(top)]))
    members = shared_table(classes.select("fp", first.alias("node")), "nodes")
    sizes = members.groupBy("node").count().where(F.col("count") > node_limit).drop("count")  # at most all block values
    large = members.join(sizes, "node", "left_semi")
    small = members.join(sizes, "node", "left_anti")
    if large.isEmpty():
        return small.select("node", F.lit("").alias("part"), "fp")
    per_block = []
    for i, b in enumerate(top):
        runs = [s for s in _blocks([x for x in range(64) if x not in b], max_bits)]
        values = []
        for j, s in enumerate(runs):  # a run may lie on both sides of block i
            low, high = [x for x in s if x < b[0]], [x for x in s if x > b[-1]]
            named = [_block_value(F.col("fp"), x).cast("string") for x in (low, high) if x]
            values.append(F.concat_ws(":", "node", F.lit(j), *named))
        per_block.append(F.when(F.col("node").startswith(f"{i}:"), F.array(*values)))
    second = shared_table(large.select("fp", F.explode(F.coalesce(*per_block)).alias("node")), "nodes")
    counted = second.groupBy("node").count()
    over = counted.where(F.col("count") > node_limit).select("node", F.ceil(F.col("count") / node_limit).cast("int").alias("segments"))
    placed = second.join(over, "node", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("segments")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("segments") - 1),
        lambda other: F.concat_ws("-", F.least(own, other).cast("string"), F.greatest(own, other).cast("string")),
    )
    parts = F.when(F.col("segments").isNull(), F.array(F.lit(""))).otherwise(pairs)
    return small.select("node", F.lit("").alias("part"), "fp").unionByName(placed.select("node", F.explode(parts).alias("part"), "fp"))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the order of the reflected Gray code."""
    rank = values.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all rows that the pairs ``a, b`` connect the same smallest label, in place."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def tree_levels(fps: np.ndarray, group_start: np.ndarray) -> list[tuple]:
    """Levels from the leaves up, for rows in order of (group, Gray rank).  A level is
    ``(first row, residual mask, pattern, first child, children)`` per node; no node crosses a group."""
    n = len(fps)
    local = np.arange(n) - group_start
    longest = int(local.max()) + 1 if n else 0
    first, width, levels = np.arange(n), 1, []
    full = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    masks, patterns, children = full, fps, None
    while True:
        levels.append([first, masks, patterns, children])
        if width >= longest:
            break
        width *= FANOUT
        new_first = np.flatnonzero(local % width == 0)
        at = np.searchsorted(first, new_first)
        agree = ~(np.bitwise_or.reduceat(fps, new_first) ^ np.bitwise_and.reduceat(fps, new_first))
        count = np.diff(np.append(at, len(first)))
        levels[-1][1] = masks & ~np.repeat(agree, count)  # what the parent holds is not looked at again
        first, masks, patterns, children = new_first, agree, fps[new_first], (at, count)
    return levels


def link_labels(group: np.ndarray, fps: np.ndarray, max_bits: int, frontier: int = FRONTIER) -> np.ndarray:
    """Rows in order of (group, Gray rank) -> for each row the first row of its group that links of
    at most ``max_bits`` differing bits connect it with."""
    n = len(fps)
    label = np.arange(n)
    if n == 0:
        return label
    new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(new, n))
    start, end = np.repeat(new, size), np.repeat(new + size, size)
    levels = tree_levels(fps, start)
    top_first = levels[-1][0]
    top_of = np.searchsorted(top_first, start)  # one top node per group
    work = np.cumsum(end - np.arange(n))
    cuts = [0, *np.flatnonzero(np.diff(work // frontier)).tolist(), n]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        query = np.arange(lo, hi)
        node, seen = top_of[lo:hi], np.zeros(hi - lo, dtype=np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            first, mask, pattern, children = levels[depth]
            seen = seen + np.bitwise_count((fps[query] ^ pattern[node]) & mask[node])
            after = np.append(first[1:], n)
            keep = (seen <= max_bits) & (after[node] - 1 > query)  # each pair is met once, from its earlier row
            query, node, seen = query[keep], node[keep], seen[keep]
            if depth:
                at, count = children
                times = count[node]
                offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                query, seen, node = np.repeat(query, times), np.repeat(seen, times), np.repeat(at[node], times) + offset
        join_labels(label, query, node)
    return label


def find_links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(node, part, fp)`` -> ``(a, b)``: links that connect within each node's part what lies within
    ``max_bits`` differing bits (a spanning forest, not all pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def search(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((gray_rank(fps), group))
            group, fps = group[order], fps[order]
            label = link_labels(group, fps, max_bits)
            linked = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(fps[linked].view(np.int64)), pa.array(fps[label[linked]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            group, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            others = np.flatnonzero(group != group[-1])
            whole = int(others[-1]) + 1 if len(others) else 0  # the last group may go on in the next batch
            if whole:
                yield search(group[:whole], fps[:whole])
            held = [(group[whole:], fps[whole:])]
        if held:
            yield search(*held[0])

    keyed = nodes.select(F.xxhash64("node", "part").alias("key"), "fp")  # a clash of two keys only adds candidates
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, node_limit: int = NODE_LIMIT
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``, repeated rows included.

    Fingerprints with at most ``max_bits`` differing bits link; ``component_id`` is the smallest
    id that links reach, the row's own included.  Null and wordless texts have fingerprint zero
    and link like any other.  A null id is never the smallest; a component of null ids only has a
    null ``component_id``.  Other columns are not looked at.  No rows give no rows.
    """
    rows = shared_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = shared_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    roots = component_roots(find_links(index_nodes(classes.select("fp"), max_bits, node_limit), max_bits))
    rooted = classes.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` (all columns) whose id is the smallest of their component.

    Rows that repeat an id are one document: one of them stays.  Rows without an id stay only
    where no row of their component has an id, one per fingerprint.
    """
    found = shared_table(simhash_components(docs, id_col, text_col, **options), "components")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
    often = shared_table(kept.groupBy("kept_id").count().where("count > 1").select("kept_id"), "repeated")
    nameless = found.where("doc_id is null and component_id is null").select("fingerprint").distinct()
    if often.isEmpty():
        named = docs.join(kept, F.col(id_col) == F.col("kept_id"), "left_semi")
    else:
        once = docs.join(kept.join(often, "kept_id", "left_anti"), F.col(id_col) == F.col("kept_id"), "left_semi")
        named = once.unionByName(docs.join(often, F.col(id_col) == F.col("kept_id"), "left_semi").dropDuplicates([id_col]))
    if nameless.isEmpty():
        return named
    bare = docs.where(F.col(id_col).isNull())
    shingle = options.get("shingle", SHINGLE_WORDS)
    texts = bare.select(F.col(text_col).cast("string")).distinct()
    fps = map_rows(texts, lambda: lambda c: [c[0], [fingerprint(t, shingle) for t in c[0]]], "own_text string, fp long")
    fps = fps.withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0"))).join(nameless, "fingerprint", "left_semi").dropDuplicates(["fp"])
    left = bare.join(fps.select("own_text"), F.col(text_col).eqNullSafe(F.col("own_text")), "left_semi").dropDuplicates([text_col])
    return named.unionByName(left)

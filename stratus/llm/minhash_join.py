"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

Method: a document's set is its distinct word shingles.  Its signature has one symbol per hash
function: the low 16 bits of the set's least hash.  Sets of Jaccard similarity s agree in a symbol
with probability s.  The signature is cut into chunks; two signatures of distance
``chunks * (errors + 1) - 1`` or less have, by the pigeonhole, a chunk with ``errors`` differing
symbols at most, so they share one of the keys that leave out ``errors`` symbols of a chunk, and
every pair under that distance meets.  What meets is compared by signature, then on the full sets.

With 20 chunks of 5 symbols and one error the distance is 39 of 100: a pair of similarity 0.8, the
limit itself, lies above it with probability 4e-6, one of 0.85 with 1e-9.

Scale: equal sets are one class before anything is compared.  Classes that share a key are first
joined as a star (each task does so for its own classes, so that a key many classes share is one
row per task), and the star pairs are confirmed.  Signatures also join classes to families: a key whose classes lie in several
families is searched for near pairs between them.  The components of a family are then compared
on full sets, in parts of bounded size that emit a spanning forest of links.  Neither step emits all pairs of
a group, and a pair under the signature distance always has one family.  Texts of
classes that have a candidate are read a second time for their sets; other sets never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import bound_batches, map_rows, shared_table, ship_by_value
from stratus.llm.components import component_roots

ship_by_value(__name__)

SHINGLE_WORDS = 2
#: similarity in hundredths
MIN_PERCENT = 80
SEED = 42
CHUNKS, CHUNK_SYMBOLS, CHUNK_ERRORS = 20, 5, 1
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: signatures that differ in more symbols are not near
MAX_DISTANCE = CHUNKS * (CHUNK_ERRORS + 1) - 1
#: classes whose keys a task combines at once
COMBINE_ROWS = 20_000
#: classes of a key that a task compares with as many others
PART_LIMIT = 4096
#: elements that a signature is computed over at once
HASH_BLOCK = 8192

_draw = np.random.default_rng(SEED)
XOR = _draw.integers(0, 1 << 64, SYMBOLS, dtype=np.uint64)[:, None]
MULTIPLY = _draw.integers(0, 1 << 64, SYMBOLS, dtype=np.uint64)[:, None] | np.uint64(1)
#: the symbols of each key: every chunk without every choice of allowed errors
KEYS = np.array([c for k in range(CHUNKS) for c in combinations(range(k * CHUNK_SYMBOLS, (k + 1) * CHUNK_SYMBOLS), CHUNK_SYMBOLS - CHUNK_ERRORS)])
KEY_SEEDS = _draw.integers(0, 1 << 64, len(KEYS), dtype=np.uint64)


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles.  A-Z are lower-cased, words end at ASCII white
    space; fewer words than a shingle has are one shingle; without words the set is empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        distinct = {joined}
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        distinct = {joined[a : b - 1] for a, b in zip([0, *ends[:-size]], ends[size - 1 :], strict=True)}
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in distinct), dtype=np.uint64, count=len(distinct))
    hashes.sort()
    return hashes


def signature(hashes: np.ndarray) -> np.ndarray:
    """The 16-bit symbols of a set that is not empty."""
    least = np.full(SYMBOLS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(hashes), HASH_BLOCK):
        np.minimum(least, ((hashes[start : start + HASH_BLOCK] ^ XOR) * MULTIPLY).min(1), out=least)
    return least.astype(np.uint16)


def key_values(signatures: np.ndarray) -> np.ndarray:
    """64-bit keys of each row of ``signatures`` (rows x keys); a clash of two keys only adds candidates."""
    value = np.broadcast_to(KEY_SEEDS, (len(signatures), len(KEYS))).copy()
    for i in range(KEYS.shape[1]):
        value = (value ^ signatures[:, KEYS[:, i]]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value.view(np.int64)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), SYMBOLS)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _batch(names: list[str], *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``rows`` rows or more each."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def set_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(doc_id, text_key, n, digest, sig)`` of every row; an empty set has no digest and no signature."""

    def measure(columns):
        out: list[list] = [[], [], []]
        for text in columns[2]:
            hashes = shingle_set(text, shingle)
            out[0].append(len(hashes))
            out[1].append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
            out[2].append(signature(hashes).tobytes() if len(hashes) else None)
        return [columns[0], columns[1], *out]

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return map_rows(rows, lambda: measure, "doc_id long, text_key long, n long, digest binary, sig binary")


def star_candidates(classes: DataFrame) -> DataFrame:
    """``(cls, sig)`` -> ``(a, b)``, ``a < b``: pairs that connect all classes that share a key (a tree per key, not all pairs)."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(key, a, b)``: one row per key of the task's classes (``b`` -1), and the pairs of the task's own stars."""
        for batch in _gathered(batches, COMBINE_ROWS):
            cls, keys = _numbers(batch.column(0)), key_values(_signatures(batch.column(1)))
            member = np.repeat(cls, keys.shape[1])
            order = np.lexsort((member, keys.ravel()))
            key, member = keys.ravel()[order], member[order]
            first = np.append(True, key[1:] != key[:-1])
            pivot = member[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            yield _batch(["key", "a", "b"], key[first], member[first], np.full(first.sum(), -1))
            pairs = np.unique(np.stack([pivot[~first], member[~first]], 1), axis=0)
            yield _batch(["key", "a", "b"], pairs[:, 1] * 31, pairs[:, 0], pairs[:, 1])  # dealt by their second class

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In order of (key, a): the first row of a key is its pivot, also over the ends of batches."""
        last, pivot = None, None
        for batch in _gathered(batches, 1 << 16):
            key, a, b = (_numbers(c) for c in batch.columns)
            made = b >= 0
            pairs = [np.stack([a[made], b[made]], 1)]
            key, a = key[~made], a[~made]
            if len(key):
                first = np.append(last is None or key[0] != last, key[1:] != key[:-1])
                at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
                own = np.where(at < 0, a[0] if pivot is None else pivot, a[np.maximum(at, 0)])
                last, pivot = key[-1], own[-1]
                pairs.append(np.stack([own[~first], a[~first]], 1))
            both = np.unique(np.concatenate(pairs), axis=0)
            yield _batch(["a", "b"], both[:, 0], both[:, 1])

    combined = bound_batches(classes.select("cls", "sig")).mapInArrow(combine, "key long, a long, b long")
    dealt = combined.repartition("key").sortWithinPartitions("key", "a")
    return dealt.mapInArrow(stars, "a long, b long").where("a <> b").distinct()


def near_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``(a, b, distance)`` of the pairs whose sizes and signatures allow the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distance = (_signatures(batch.column(2)) != _signatures(batch.column(3))).sum(1)
                near = distance <= MAX_DISTANCE
                yield _batch(["a", "b", "distance"], _numbers(batch.column(0))[near], _numbers(batch.column(1))[near], distance[near])

    first = classes.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    second = classes.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    both = pairs.join(first, "a").join(second, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return bound_batches(both.select("a", "b", "sig_a", "sig_b")).mapInArrow(compare, "a long, b long, distance long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``(a, b)`` whose full sets have the similarity."""

    def similar(columns):
        out = []
        for x, y in zip(columns[2], columns[3], strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            at = np.searchsorted(y, x)
            shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            out.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return [columns[0], columns[1], out]

    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y")), "b")
    return map_rows(both.select("a", "b", "x", "y"), lambda: similar, "a long, b long, linked boolean").where("linked").select("a", "b")


def sets_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(cls, hashes)`` of the classes in ``wanted`` (``cls, doc_id, text_key`` of one row each), from their texts."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    one = wanted.select("cls", F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"))
    found = rows.join(one, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))).select("cls", "text")
    hashed = map_rows(found, lambda: lambda c: [c[0], [shingle_set(t, shingle).tobytes() for t in c[1]]], "cls long, hashes binary")
    return hashed.dropDuplicates(["cls"])  # rows that repeat both id and text


def open_members(classes: DataFrame) -> DataFrame:
    """``(cls, component, sig)`` -> ``(key, cls, component)``: the classes of every key that lie in several components."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = key_values(_signatures(batch.column(2)))
                cls, component = (np.repeat(_numbers(batch.column(i)), keys.shape[1]) for i in (0, 1))
                yield _batch(["key", "cls", "component"], keys.ravel(), cls, component)

    keys = shared_table(bound_batches(classes.select("cls", "component", "sig")).mapInArrow(keyed, "key long, cls long, component long"), "class-keys")
    spans = keys.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return keys.join(spans.where("low <> high"), "key", "left_semi").select("key", "cls", "component")


def open_parts(members: DataFrame, classes: DataFrame, part_limit: int = PART_LIMIT) -> DataFrame:
    """``(key, cls[, component])`` and ``(cls, component, ...)`` -> ``(node, cls, component, ...)`` of the keys whose classes lie in
    several components.  A key with over ``part_limit`` classes is cut into parts in which each class meets
    all those of other components, but those of the largest one do not meet each other.  Members that come with the ``component`` are not joined for it."""
    placed = shared_table(members if "component" in members.columns else members.join(classes.select("cls", "component"), "cls"), "open-keys")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    cut = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all"), F.count("*").alias("components"))
    cut = cut.where("components > 1").select(
        "key",
        F.col("main.component").alias("main"),
        F.ceil(F.col("main.size") / part_limit).cast("int").alias("mains"),
        F.ceil((F.col("all") - F.col("main.size")) / part_limit).cast("int").alias("others"),
        (F.col("all") <= part_limit).alias("whole"),
    )
    # a table of its own, a row per key: the join neither reuses a shuffle by key for the counts nor keeps a hot key whole
    cut = shared_table(cut, "open-cuts")
    own = F.when(F.col("component") == F.col("main"), F.pmod(F.xxhash64("cls"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("cls"), F.col("others"))).cast("int")
    dealt = placed.join(cut, "key").withColumn("own", own)
    against_others = F.expr("transform(sequence(0, others - 1), o -> concat(o, 'm', own))")
    other_side = F.expr("concat(transform(sequence(0, mains - 1), m -> concat(own, 'm', m)), transform(sequence(0, others - 1), o -> concat(least(o, own), 'o', greatest(o, own))))")
    parts = F.when(F.col("whole"), F.array(F.lit(""))).when(F.col("component") == F.col("main"), against_others).otherwise(other_side)
    nodes = dealt.select("cls", "key", F.explode(parts).alias("part")).select("cls", F.xxhash64("key", "part").alias("node"))
    return nodes.join(classes, "cls").select("node", *classes.columns)


def _search_nodes(parts: DataFrame, search) -> DataFrame:
    """``(a, b)`` pairs that ``search(cls, component, payload)`` finds in each node; ``payload`` is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (*(_numbers(batch.column(i)) for i in range(3)), np.array(batch.column(3).to_pylist(), dtype=object))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            cuts = [0, *(np.flatnonzero(held[0][1:] != held[0][:-1]) + 1).tolist()]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # the last node may go on in the next batch
                yield pairs(*(x[lo:hi] for x in held[1:]))
            held = tuple(x[cuts[-1] :] for x in held)
        if held is not None:
            yield pairs(*held[1:])

    def pairs(cls, component, payload):
        _, label, size = np.unique(component, return_inverse=True, return_counts=True)
        order = np.lexsort((cls, label, -size[label]))  # the largest component first; its classes never start a search
        found = np.array(search(cls[order], label[order], payload[order], int(size.max())), dtype=np.int64).reshape(-1, 2)
        return _batch(["a", "b"], found.min(1, initial=1 << 62), found.max(1, initial=-1))

    rows = parts.repartition("node").sortWithinPartitions("node")
    return bound_batches(rows).mapInArrow(run, "a long, b long").distinct()


def near_across(parts: DataFrame) -> DataFrame:
    """``(node, cls, component, sig)`` -> ``(a, b)``: pairs near by signature that connect what is near in a node across
    components (a class's nearest partner in each component before its own, not all pairs)."""

    def search(cls, label, payload, start):
        sig = np.frombuffer(b"".join(payload), dtype=np.uint16).reshape(len(payload), SYMBOLS)
        for i in range(start, len(cls)):
            others = np.flatnonzero(label[:i] != label[i])
            distance = (sig[others] != sig[i]).sum(1)
            near, distance = others[distance <= MAX_DISTANCE], distance[distance <= MAX_DISTANCE]
            near = near[np.lexsort((distance, label[near]))]
            for j in near[np.append(True, label[near[1:]] != label[near[:-1]])[: len(near)]]:
                yield cls[i], cls[j]

    return _search_nodes(parts.select("node", "cls", "component", "sig"), lambda *x: list(search(*x)))


#: classes compared at once with all of a node, and elements of the node's sets looked at together
SET_BLOCK, ELEMENT_BLOCK = 64, 1 << 18


def similar_rows(sets: list[np.ndarray], start: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each place ``i`` from ``start``: the earlier places whose sets have the similarity with set ``i``."""
    size = np.array([len(x) for x in sets])
    last = np.cumsum(size)
    for low in range(start, len(sets), SET_BLOCK):
        block = sets[low : low + SET_BLOCK]
        words, at = np.unique(np.concatenate(block), return_inverse=True)
        holds = np.zeros((len(words), len(block)), dtype=np.uint8)
        holds[at, np.repeat(np.arange(len(block)), [len(x) for x in block])] = 1
        shared = np.zeros((low + len(block), len(block)), dtype=np.int64)
        first = 0
        while first < len(shared):
            after = max(first + 1, int(np.searchsorted(last, (last[first - 1] if first else 0) + ELEMENT_BLOCK)))
            rows = sets[first : min(after, len(shared))]
            values = np.concatenate(rows)
            place = np.minimum(np.searchsorted(words, values), len(words) - 1)
            known = words[place] == values
            owner = np.repeat(np.arange(first, first + len(rows)), [len(x) for x in rows])[known]
            if len(owner):
                new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                shared[owner[new]] = np.add.reduceat(holds[place[known]], new, axis=0, dtype=np.int64)
            first += len(rows)
        for k in range(len(block)):
            i = low + k
            yield i, np.flatnonzero(100 * shared[:i, k] >= percent * (size[:i] + size[i] - shared[:i, k]))


def links_across(parts: DataFrame, percent: int) -> DataFrame:
    """``(node, cls, component, hashes)`` -> ``(a, b)``: links by full sets that connect the components of a node as
    all its links do (a spanning forest, not all pairs)."""

    def search(cls, label, payload, start):
        label = label.copy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in payload]
        for i, linked in similar_rows(sets, start, percent):
            while len(other := linked[label[linked] != label[i]]):
                yield cls[i], cls[other[0]]
                label[label == label[other[0]]] = label[i]

    return _search_nodes(parts.select("node", "cls", "component", "hashes"), lambda *x: list(search(*x)))


def labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with the ``component`` that links put each in, written to the shared folder."""
    roots = component_roots(links).withColumnsRenamed({"a": "cls", "root": "component"})
    out = classes.join(roots, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    return shared_table(out, "labelled")


def minhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, percent: int = MIN_PERCENT, part_limit: int = PART_LIMIT
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``, repeated rows included.

    Documents whose sets have ``100 * intersection >= percent * union`` link; ``component_id`` is the
    smallest id that links reach, the row's own included, and ``kept`` tells whether that is the row's.  Null and
    wordless texts have no set and link with nothing.  A null id is never the smallest: a component
    of null ids only has a null ``component_id`` and its rows are kept.  Other columns are not looked at;
    no rows give no rows.
    """
    rows = shared_table(set_rows(docs, id_col, text_col, shingle), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")
    grouped = rows.where("n > 0").groupBy("digest").agg(first, F.max("n").alias("n"), F.max("sig").alias("sig"))
    # numbered in the written table, where the numbers stay as they are
    named = grouped.select(F.monotonically_increasing_id().alias("cls"), "digest", "first.doc_id", "first.text_key", "n", "sig")
    classes = shared_table(named, "classes")
    # a smaller set than this links with no other set
    linkable = classes.where(F.col("n") * 100 >= (F.col("n") + 1) * percent).select("cls", "n", "sig")
    candidates = shared_table(star_candidates(linkable), "candidates")
    near = shared_table(near_pairs(candidates, linkable, percent), "near")
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    nodes = shared_table(ends(candidates), "nodes")
    sets = shared_table(sets_of(classes.join(nodes, "cls", "left_semi"), docs, id_col, text_col, shingle), "candidate-sets")
    links = shared_table(confirm(near.select("a", "b"), sets, percent), "links")
    # families: what is near by signature, also where no star shows it
    signed = linkable.select("cls", "sig").join(nodes, "cls", "left_semi")
    family = labelled(signed, near)
    more = shared_table(near_across(open_parts(open_members(family), family, part_limit)), "near")
    family = labelled(nodes, near.select("a", "b").unionByName(more))
    # links between the components of a family
    component = labelled(sets, links)
    parts = open_parts(family.select(F.col("component").alias("key"), "cls"), component, part_limit)
    links = links.unionByName(shared_table(links_across(parts, percent), "links"))
    roots = component_roots(links).withColumnRenamed("a", "cls")
    rooted = classes.select("cls", "digest", F.col("doc_id").alias("least_id")).join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = shared_table(rooted.select("digest", "root").join(least, "root").select("digest", "component_id"), "components")
    joined = rows.select("doc_id", "n", "digest").join(found, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

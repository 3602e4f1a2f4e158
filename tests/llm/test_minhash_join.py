"""MinHash near-dedup against all pairs."""

import random
import re

import numpy as np

from stratus.llm import minhash_join as mj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def brute(rows, percent=80):
    """``rows``: (doc_id, text) -> sorted (doc_id, n_shingles, component_id, kept); ids and texts may be null."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return by_row((d, len(sets[i]), c := least.get(top(i)) if sets[i] else d, d == c) for i, (d, _) in enumerate(rows))


def by_row(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def found(df):
    return by_row(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def edited(draw, words, share):
    words = list(words)
    for _ in range(round(len(words) * share)):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return words


def test_keys_hold_every_pair_under_the_distance():
    """The pigeonhole: whatever symbols differ, up to the limit, some key is shared."""
    draw = np.random.default_rng(5)
    assert len(mj.KEYS) == mj.CHUNKS * mj.CHUNK_SYMBOLS and mj.MAX_DISTANCE == 39
    for _ in range(500):
        a = draw.integers(0, 1 << 16, mj.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        # the worst case: two differing symbols in as many chunks as possible
        wrong = draw.choice(mj.SYMBOLS, mj.MAX_DISTANCE, replace=False)
        if draw.random() < 0.5:
            per = np.repeat(np.arange(mj.CHUNKS), 2)[: mj.MAX_DISTANCE]
            wrong = per * mj.CHUNK_SYMBOLS + np.tile(draw.choice(mj.CHUNK_SYMBOLS, 2, replace=False), mj.CHUNKS)[: mj.MAX_DISTANCE]
        b[wrong] ^= 1
        assert (a != b).sum() == len(set(wrong.tolist()))
        assert (mj.key_values(a[None]) == mj.key_values(b[None])).any()


def test_signatures_estimate_similarity():
    draw = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    for share in (0.02, 0.1, 0.3):
        x, y = mj.shingle_set(" ".join(words)), mj.shingle_set(" ".join(edited(draw, words, share)))
        shared = len(np.intersect1d(x, y))
        similarity = shared / (len(x) + len(y) - shared)
        assert abs((mj.signature(x) == mj.signature(y)).mean() - similarity) < 0.2


def test_equal_to_all_pairs(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(mj.minhash_components(documents)) == brute(rows)


def groups_of_copies(draw):
    """Near copies that link in chains, near misses that share most of a passage, and small sets."""
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(12):
            rows.append(edited(draw, base, draw.choice([0.0, 0.02, 0.05, 0.12])))
        chain = list(base)
        for _ in range(10):
            chain = edited(draw, chain, 0.05)
            rows.append(chain)
    passage = [f"common{i}" for i in range(70)]
    for g in range(40):
        rows.append(passage + [f"own{g}x{i}" for i in range(draw.choice([10, 20, 30]))])
    for n in range(1, 9):
        rows += [[f"s{i}" for i in range(n)], [f"s{i}" for i in range(n + 1)], [f"S{i}" for i in range(n)]]
    return [(10_000 - i, " ".join(w)) for i, w in enumerate(rows)]


def test_chains_near_misses_and_small_sets(spark):
    rows = groups_of_copies(random.Random(11))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert len({r[2] for r in want}) < len(rows) - 40
    assert found(mj.minhash_components(docs)) == want
    assert found(mj.minhash_components(docs, part_limit=3)) == want


def test_parts_let_all_components_of_a_key_meet(spark):
    draw = random.Random(4)
    sig = mj.signature(mj.shingle_set("one text for all"))
    rows = [(i, draw.choice([0, 0, 0, 0, 1, 2, 3]), bytearray(sig.tobytes())) for i in range(60)]
    classes = spark.createDataFrame(rows, "cls long, component long, sig binary")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1]}
    members = mj.open_members(classes)
    assert members.count() == len(rows) * len(mj.KEYS)
    for limit in (1000, 7, 2):
        nodes = {}
        for r in mj.open_parts(members.where(f"key = {mj.key_values(sig[None])[0, 0]}"), classes, limit).collect():
            nodes.setdefault(r.node, []).append((r.cls, r.component))
        met = {(a[0], b[0]) for m in nodes.values() for a in m for b in m if a[0] < b[0] and a[1] != b[1]}
        assert met == want and (limit == 1000) == (len(nodes) == 1)
        near = {tuple(r) for r in mj.near_across(mj.open_parts(members, classes, limit)).collect()}
        assert near < want and {i for p in near for i in p} >= {r[0] for r in rows if r[1]}


def test_similar_rows_equal_to_pairs():
    draw = random.Random(8)
    sets = [np.array(sorted(draw.sample(range(40), draw.randint(1, 30))), dtype=np.uint64) for _ in range(150)]
    for i, found in mj.similar_rows(sets, 20, 50):
        x = set(sets[i].tolist())
        assert found.tolist() == [j for j in range(i) if 100 * len(x & (y := set(sets[j].tolist()))) >= 50 * len(x | y)]


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(mj.minhash_components(odd_docs)) == brute(rows)
    assert mj.minhash_components(no_docs).collect() == []
    bare = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert found(mj.minhash_components(bare)) == brute([(None, "a b c d e f")] * 2 + [(None, None)])


def test_rows_of_open_keys_grow_with_the_classes(spark):
    """At most a row per class and key, however many classes of two components share each of them."""
    draw = np.random.default_rng(8)
    base, made = draw.integers(0, 1 << 16, mj.SYMBOLS, dtype=np.uint16), []
    for n in (100, 200):
        rows = []
        for i in range(n):
            sig = base.copy()
            sig[draw.integers(0, mj.SYMBOLS, 3)] = draw.integers(0, 1 << 16, 3, dtype=np.uint16)
            rows.append((i, i % 2, bytearray(sig.tobytes())))
        classes = spark.createDataFrame(rows, "cls long, component long, sig binary")
        members = mj.open_members(classes)
        assert "LeftSemi" in members._jdf.queryExecution().optimizedPlan().toString()
        parts = mj.open_parts(members, classes, part_limit=1000)
        made.append((members.count(), parts.count()))
        assert made[-1][0] == made[-1][1] <= n * len(mj.KEYS)
    assert made[1][0] <= 2.5 * made[0][0]


def test_open_keys_bring_their_components(spark, monkeypatch):
    """No join looks up what the members of open keys come with; the parts are those that such a join gives."""
    draw = np.random.default_rng(9)
    base, rows = draw.integers(0, 1 << 16, mj.SYMBOLS, dtype=np.uint16), []
    for i in range(40):
        sig = base.copy()
        sig[draw.integers(0, mj.SYMBOLS, 3)] = draw.integers(0, 1 << 16, 3, dtype=np.uint16)
        rows.append((i, i % 3, bytearray(sig.tobytes())))
    classes = spark.createDataFrame(rows, "cls long, component long, sig binary")
    written, write = {}, mj.shared_table
    monkeypatch.setattr(mj, "shared_table", lambda df, name: written.update({name: df}) or write(df, name))
    members = mj.open_members(classes)
    for limit in (1000, 5):
        parts = sorted((r.node, r.cls, r.component) for r in mj.open_parts(members, classes, limit).collect())
        assert "Join Inner" not in written["open-keys"]._jdf.queryExecution().optimizedPlan().toString()
        looked_up = mj.open_parts(members.select("key", "cls"), classes, limit)
        assert "Join Inner" in written["open-keys"]._jdf.queryExecution().optimizedPlan().toString()
        assert parts == sorted((r.node, r.cls, r.component) for r in looked_up.collect())

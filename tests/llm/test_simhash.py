"""SimHash near-dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from stratus.llm import components, simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, bits=4):
    """Smallest index reachable for each fingerprint."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits) + i + 1:
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


@pytest.mark.parametrize("limit", [8192, 5])
def test_query_equals_brute_force(spark, documents, texts, limit):
    rows = simhash.simhash_components(documents, node_limit=limit).collect()
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    root = dict(zip(ids, (ids[k] for k in brute_components(fps)), strict=True))
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in zip(ids, fps, strict=True)}
    assert {r.doc_id: r.component_id for r in rows} == root


def clustered(n, seed):
    """Fingerprints around a few centres, so that blocks are shared and paths are long."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    found = set()
    while len(found) < n:
        fp = rng.choice([*centres, *list(found)[:20]])
        for _ in range(rng.randint(0, 5)):
            fp ^= 1 << rng.randrange(64)
        found.add(fp)
    return sorted(found)


@pytest.mark.parametrize("limit", [8192, 60, 7])
def test_links_of_dense_groups(spark, limit):
    fps = clustered(400, 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = simhash.index_nodes(spark.createDataFrame([(f,) for f in signed], "fp long"), node_limit=limit)
    roots = {r.a: r.root for r in components.component_roots(simhash.find_links(nodes)).collect()}
    got = [roots.get(f, f) for f in signed]
    want = brute_components(fps)
    groups = {}
    for g, w in zip(got, want, strict=True):
        assert groups.setdefault(g, w) == w
    assert len(groups) == len(set(want))


def test_link_labels_prunes_nothing_that_links():
    fps = np.array(clustered(300, 8), dtype=np.uint64)
    group = np.arange(300) % 3
    order = np.lexsort((simhash.gray_rank(fps), group))
    for frontier in (1, 50, 1 << 20):
        label = simhash.link_labels(group[order], fps[order], 4, frontier)
        for g in range(3):
            at = np.flatnonzero(group[order] == g)
            want = brute_components(fps[order][at].tolist())
            assert [at[w] for w in want] == label[at].tolist()


def test_gray_rank_is_the_inverse_of_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.a: r.root for r in components.component_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}}


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.simhash_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {3, 4, 5, None} and {r.component_id for r in zero} == {3}
    line = simhash.fingerprint("Some plain words that make a line of text")
    assert {r.component_id for r in rows if r.fingerprint == f"{line % (1 << 64):016x}"} == {9}
    assert simhash.simhash_components(no_docs).count() == 0


def test_drop_near_copies_keeps_one_row_of_each_group(odd_docs, no_docs):
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and {3, 6, 8, 9, 10, 11} <= set(ids) and not {4, 5, None} & set(ids)
    assert simhash.drop_near_copies(no_docs).count() == 0


def test_nameless_rows_stay_once(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "quite other words here now then")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.drop_near_copies(docs).collect()) == ["a b c d e f", "quite other words here now then"]

"""Source divergence audit against a dense brute-force version."""

import random
import re
from collections import Counter, defaultdict

from stratus.llm import source_audit

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs, top):
    """``rows``: (lang, source, text) -> set of (lang, source, part, item, value, rank)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = set()
    for lang in {r[0] for r in rows}:
        held, counts = Counter(), defaultdict(Counter)
        for _, source, text in (r for r in rows if r[0] == lang):
            terms = WORD.findall(lower(text))
            held.update(set(terms))
            counts[source].update(terms)
        kept = [t for t in held if held[t] >= min_docs]
        v = len(kept)

        def shares(counter, kept=kept, v=v):
            n = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // (n + 2 * v) for t in kept}

        whole = shares(sum(counts.values(), Counter()))
        p = {s: shares(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], whole[t])) for t in kept if counts[s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                found |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return found


def check(spark, rows, min_docs, top=10, **cuts):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    shares = source_audit.Shares(docs, "lang", "source", "text", min_docs)
    pairs = source_audit.source_pairs(shares, **cuts).selectExpr("lang", "source", "'pair' AS part", "item", "value", "rank")
    terms = source_audit.top_terms(shares, top).selectExpr("lang", "source", "'term' AS part", "item", "value", "rank")
    got = [tuple(r) for r in pairs.union(terms).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, min_docs, top)


def test_translate_table_cuts_as_the_pattern():
    chars = [chr(c) for c in range(0x180)] + list(" ▁漢字\U00010348éÀ")
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choices(chars, k=40))
        assert source_audit.term_counts(text) == Counter(t.encode() for t in WORD.findall(lower(text)))


def test_equal_to_brute_force_for_all_cuts(spark):
    draw = random.Random(7)
    words = [f"w{chr(97 + i)}é" for i in range(20)] + ["The", "THE", "the", "a1b", "Z"]
    rows = [
        (draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", "Ä", None, ""]), " ".join(draw.choices(words, k=draw.randint(0, 12))))
        for _ in range(120)
    ]
    rows += [("fr", "only", "the words of one source"), ("xx", "s1", None), ("xx", "s2", ""), ("en", "empty", None)]
    check(spark, rows, min_docs=3)
    check(spark, rows, min_docs=3, top=2, tile_sources=2, block_terms=4)
    check(spark, rows, min_docs=1, tile_sources=1, block_terms=1)


def test_ties_repeats_and_large_counts(spark):
    rows = [("en", s, "same same text text") for s in "abc" for _ in range(4)] + [("en", "d", "word " * 40_000)]
    check(spark, rows, min_docs=1)
    whole = _value(spark, "10000000000000000", "10000000000000000", "5")
    assert whole == 1 + 10**9 * (10**16 + 2) // (10**16 + 10)


def _value(spark, n, total, kept):
    return spark.sql(f"SELECT {source_audit._share(f'cast({n} as bigint)', f'cast({total} as bigint)', f'cast({kept} as bigint)')} AS v").first().v


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    found = source_audit.audit_sources(odd_docs, source_col="word").collect()
    assert not [r for r in found if r.part == "pair"]  # one source
    rows = [(r.lang, str(r.key), r.text) for r in odd_docs.collect()]
    docs = odd_docs.withColumn("source", odd_docs.key.cast("string")).drop("score")
    assert {tuple(r) for r in source_audit.audit_sources(docs, min_docs=2).collect()} == brute(rows, 2, 10)
    assert source_audit.audit_sources(no_docs, source_col="word").collect() == []

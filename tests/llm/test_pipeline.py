"""The pipeline against its stages' rules applied by hand."""

import re

import corpus_pipeline
from stratus.llm import substring_dedup
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_text_operators import brute_passages

SF001 = "/root/testdata/sf0.001"


def words(text):
    return " ".join(re.findall(r"\w+", text.lower()))


def by_hand(spark, texts):
    kept = {i: t for i, t in texts.items() if t and any(map(str.isalpha, t))}
    ids = sorted(kept)
    roots = brute_components([brute_fingerprint(kept[i]) for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if roots[k] == k}
    gone, out = brute_passages(kept, substring_dedup.MIN_WORDS), {}
    for i in sorted(kept):
        rest = substring_dedup.without_units(kept[i], "sentence", set(gone.get(i, ())))
        if rest.strip():
            out[i] = rest
    items = [words(r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    return {i: t for i, t in out.items() if not any(x in words(t) for x in items)}


def test_run_equals_brute_force(spark, documents, texts):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF001).collect()}
    want = by_hand(spark, texts)
    assert {i: r.text for i, r in rows.items()} == want
    for r in rows.values():
        assert r.round_trip and r.n_pieces == len(r.piece_ids) and r.n_chars == len(r.text)


def test_stages_keep_the_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF001)
            assert docs.columns == odd_docs.columns
            docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece_encoding"]

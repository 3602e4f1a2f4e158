"""Cross-tokenizer alignment against a plain version with both libraries' own calls."""

import hashlib
from collections import Counter

import pytest

from stratus.llm import token_alignment as ta


@pytest.fixture(scope="module")
def pair():
    return ta.TokenizerPair()


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(ta.TOKENIZER_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.TOKENIZER_B)


def ends(raw):
    out, total = [], 0
    for r in raw:
        total += len(r)
        out.append(total)
    return out


def align(pair, libraries, text):
    """``(n_a, n_b, groups as text, links as pairs of ids)``."""
    if not text:
        return 0, 0, "", []
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    raw_a, raw_b = [pair.raw_a[i] for i in a], [pair.raw_b[i] for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return 0, 0, "", []
    end_a, end_b = ends(raw_a), ends(raw_b)
    at_b = {e: j for j, e in enumerate(end_b)}
    links, groups, low_a, low_b = [], [], 0, 0
    for i, e in enumerate(end_a):
        if e in at_b:
            j = at_b[e]
            links.append((a[i], b[j]))
            groups.append(",".join(map(str, a[low_a : i + 1])) + "|" + ",".join(map(str, b[low_b : j + 1])))
            low_a, low_b = i + 1, j + 1
    return len(a), len(b), ";".join(groups), links


def brute(pair, libraries, rows):
    found = [(i, *align(pair, libraries, t)) for i, t in rows]
    counts = Counter(link for *_, links in found for link in links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (i, n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for i, n_a, n_b, groups, links in found
    ]


def rows_of(df):
    return by_row(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def by_row(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


STRANGE = ["<|endoftext|> in a text", "<s> </s> <unk> <0x41>", "a\x00b", "▁ mark", "漢字 かな ไทย \U00010348", "  two  spaces \n\n end ", " ", "\t", "x" * 3000, "ﬁ ½ é é", "don't we'll 12,345.6"]


def test_byte_alphabet_is_a_bijection():
    alphabet = ta.byte_alphabet()
    assert sorted(alphabet.values()) == list(range(256))
    assert alphabet["A"] == 0x41 and alphabet["Ġ"] == 0x20


def test_pairs_hold_every_link(pair, libraries, texts):
    for text in [*texts.values(), *STRANGE]:
        for a, b in align(pair, libraries, text)[3]:
            at = ta.np.searchsorted(pair.pairs, a * len(pair.raw_b) + b)
            assert pair.pairs[at] == a * len(pair.raw_b) + b


def test_both_encoders_of_a_agree(pair, libraries, texts):
    assert pair.ranked
    aligner = pair.aligner()
    whole = [t for t in [*texts.values(), *STRANGE] if t]
    for text, (a, _) in zip(whole, aligner.encode(whole), strict=True):
        assert list(a) == libraries[0].encode(" " + text, add_special_tokens=False).ids
    pair.ranked, plain = False, [a for a, _ in aligner.encode(whole)]
    other = pair.aligner()
    pair.ranked = True
    assert other.ranked is None and [list(a) for a, _ in other.encode(whole)] == [list(a) for a in plain]


def test_equal_to_plain_version(spark, pair, libraries, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(100_000 + i, t) for i, t in enumerate(STRANGE * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ta.align_tokens(docs, pair=pair)) == by_row(brute(pair, libraries, rows))


def test_odd_and_empty_tables(spark, pair, libraries, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.where("n = 1").collect() if r.text is None or len(r.text) < 1000]
    docs = odd_docs.where("text is null or length(text) < 1000")
    assert rows_of(ta.align_tokens(docs, pair=pair)) == by_row(brute(pair, libraries, rows))
    whole = ta.align_tokens(odd_docs, pair=pair)
    assert whole.count() == odd_docs.count() and whole.where("doc_id = 6").first().n_a > 60_000
    assert ta.align_tokens(no_docs, pair=pair).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(ta.align_tokens(nothing, pair=pair)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]

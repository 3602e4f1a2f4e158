"""SentencePiece codec and token counts against brute-force segmentation."""

import random

from stratus.llm import pieces, queries, sentencepiece_codec, token_counts

SF001 = "/root/testdata/sf0.001"
P = pieces.load_pieces()


def brute_path(token):
    """Best segmentation of a pre-token by trying all pieces at all places (equal: longer last piece)."""
    if token == pieces.SPACE:
        return P.fallback(token)
    marked = token.replace(" ", pieces.SPACE)
    best = [(0.0, [])]
    for end in range(1, len(marked) + 1):
        found = None
        for start in range(end):
            score = P.score.get(marked[start:end])
            if score is not None and (found is None or best[start][0] + score > found[0]):
                found = (best[start][0] + score, best[start][1] + [P.ids[marked[start:end]]])
        if marked[end - 1] not in P.score and (found is None or best[end - 1][0] + P.unknown > found[0]):
            found = (best[end - 1][0] + P.unknown, best[end - 1][1] + P.fallback(marked[end - 1]))
        best.append(found)
    return best[-1][1]


def random_texts(n):
    rng = random.Random(5)
    letters = "abcdehinorst éüß  \n▁\t\U00010348漢字0123.,\"\x00"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_codec_and_counts_equal_brute_force():
    codec, trie = sentencepiece_codec.Codec(P), token_counts.CountTrie(P, most_nodes=500)
    for text in random_texts(1500):
        ids = codec.encode(text).tolist()
        assert ids == [i for t in P.pre_tokens(text) for i in brute_path(t)]
        assert codec.decode(codec.encode(text)) == text
        assert trie.count(P.pre_tokens(text)) == len(ids)


def test_no_better_path_through_the_whole_text():
    """Cutting a text into pre-tokens loses nothing."""
    for text in ["a  b cde\nfoo", "Hello   world, hello", "x ▁ y"]:
        whole = 0.0
        for t in P.pre_tokens(text):
            whole += sum(P.score.get(P.raw[i].decode().replace(" ", pieces.SPACE), P.unknown) for i in brute_path(t)) if t != pieces.SPACE and "\n" not in t else 0
        marked = (" " + text).replace("▁", "\n").replace(" ", pieces.SPACE)
        best = [0.0]
        for end in range(1, len(marked) + 1):
            best.append(max([best[s] + P.score[marked[s:end]] for s in range(max(0, end - P.longest), end) if marked[s:end] in P.score] + ([best[-1]] if marked[end - 1] == "\n" else [])))
        assert abs(best[-1] - whole) < 1e-6


def test_long_pre_tokens_make_no_nodes(texts):
    trie = token_counts.CountTrie(P)
    joined = "".join("".join(texts.values()).split())[:20_000]
    for token in (joined, "a" * 9_000, "é▁\U0001f600" * 2_000):
        want = trie.insert(token)
        before = len(trie.score)
        assert trie.count([token, token]) == 2 * want == 2 * trie.count_long(token) and len(trie.score) == before
    for token in [t for text in list(texts.values())[:20] for t in P.pre_tokens(text)]:
        if token != pieces.SPACE:
            assert trie.count_long(token) == trie.insert(token)


def test_queries_agree(spark, texts):
    encoded = {r.doc_id: r for r in queries.QUERIES["op8_sentencepiece"](spark, SF001).collect()}
    counted = {r.doc_id: r for r in queries.QUERIES["op10_token_counts"](spark, SF001).collect()}
    assert sorted(encoded) == sorted(counted) == sorted(texts)
    for i, t in texts.items():
        assert encoded[i].round_trip and encoded[i].n_pieces == len(encoded[i].piece_ids) == counted[i].n_tokens
        assert counted[i].n_chars == len(t)


def test_odd_rows(odd_docs, no_docs):
    out = sentencepiece_codec.encode_texts(odd_docs)
    assert sorted(out.columns) == sorted([*odd_docs.columns, "n_pieces", "round_trip"])
    decoded = sentencepiece_codec.decode_ids(out).collect()
    for r in decoded:
        assert r.decoded == r.text
        assert (r.round_trip is None) == (r.piece_ids is None) == (r.n_pieces is None) == (r.text is None)
        assert r.text is None or r.round_trip
    assert sentencepiece_codec.encode_texts(no_docs).count() == 0
    rows = token_counts.count_tokens(odd_docs).collect()
    assert len(rows) == len(decoded) and all((r.n_tokens is None) == (r.n_chars is None) for r in rows)
    assert token_counts.count_tokens(no_docs).count() == 0

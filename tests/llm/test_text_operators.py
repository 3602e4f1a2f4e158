"""Substring dedup, decontamination, language ID, fingerprints, language model: brute force and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from stratus.llm import decontaminate, langid, lz_fingerprint, maxent_lm, queries, substring_dedup

SF001 = "/root/testdata/sf0.001"


# --- substring dedup

def test_substring_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF001}/documents.parquet'")
    want = con.sql(queries.ORACLE["op3_substring_dedup"])
    got = queries.QUERIES["op3_substring_dedup"](spark, SF001)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_repeated_spans_of_odd_rows(odd_docs, no_docs):
    rows = substring_dedup.repeated_spans(odd_docs, unit="line", min_words=5).collect()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    lines = {(r.doc_id, r.kept_doc_id, r.kept_unit, r.kept_start) for r in rows}
    assert {(2, 1, 0, 0), (9, 1, 0, 0), (None, 1, 0, 0)} <= lines
    for r in rows:
        assert any(t and t[r.start : r.end].split() and len(t[r.start : r.end].split()) == r.n_words for t in texts[r.doc_id])
    assert substring_dedup.repeated_spans(no_docs).count() == 0


def test_drop_repeats_moves_texts_once(odd_docs):
    plan = substring_dedup.drop_repeats(odd_docs, min_words=5)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("ArrowEvalPython") == 1


def test_drop_repeats_cuts_and_keeps(spark, odd_docs, no_docs):
    out = substring_dedup.drop_repeats(odd_docs, min_words=5)
    assert out.columns == odd_docs.columns
    texts = Counter((r.doc_id, r.text) for r in out.collect())
    assert texts[(2, "and a third line of its own here")] == 1
    assert texts[(9, "another text of the same document number nine")] == 1 and (9, "Some plain words that make a line of text") not in texts
    assert texts[(3, None)] == 1 and texts[(4, "")] == 1 and texts[(8, "12 34 56 !!")] == 2
    assert substring_dedup.drop_repeats(no_docs).count() == 0


def brute_units(text):
    """Sentences inside lines, character by character: ``(start, end, normalised)``."""
    out, start, i = [], 0, 0
    ends = []
    while i < len(text):
        j = i + 1
        if text[i] == "\n":
            while j < len(text) and text[j] in " \t\r\f\v":
                j += 1
            ends.append(j)
        elif text[i] in ".!?…؟।" and j < len(text) and text[j] in " \t":
            while j < len(text) and text[j] in " \t":
                j += 1
            ends.append(j)
        elif text[i] in "。！？":
            while j < len(text) and text[j] in "。！？":
                j += 1
            while j < len(text) and text[j] in " \t":
                j += 1
            ends.append(j)
        i = j
    for end in [*ends, len(text)]:
        piece = text[start:end].rstrip(" \t\r\f\v\n")
        norm = " ".join(w for w in re.split("[ \t\r\f\v\n]+", piece.lower()) if w)
        if norm:
            out.append((start, start + len(piece), norm))
        start = end
    return out


def brute_passages(texts, min_words):
    """``{doc_id: text}`` -> ``{doc_id: [unit, ...]}`` of the units to remove."""
    seen, gone = {}, {}
    for doc_id in sorted(texts):
        run, last = [], None
        for unit, (_, _, norm) in enumerate([*brute_units(texts[doc_id]), (0, 0, None)]):
            at = seen.get(norm)
            if run and (at is None or at != (last[0], last[1] + 1)):
                if sum(n for _, n in run) >= min_words:
                    gone.setdefault(doc_id, []).extend(u for u, _ in run)
                run = []
            if at is not None:
                run.append((unit, substring_dedup.count_words(norm)))
                last = at
            elif norm is not None:
                seen[norm] = (doc_id, unit)
    return gone


SENTENCES = [f"{'word' * (i % 3 + 1)} {i} is here" + " and more" * (i % 4) for i in range(40)]


def made_texts(seed):
    draw = random.Random(seed)
    passage = ". ".join(f"Passage part {i} with {' '.join(f'w{i}x{k}' for k in range(draw.randint(1, 9)))}" for i in range(12)) + "."
    texts = {}
    for i in range(60):
        parts = [draw.choice(SENTENCES) + draw.choice([". ", "! ", ".\n", "\n  ", "? \n"]) for _ in range(draw.randint(0, 6))]
        if draw.random() < 0.4:
            parts.insert(draw.randint(0, len(parts)), passage + draw.choice([" ", "\n"]))
        if draw.random() < 0.2:
            parts.append("漢字の文章がここにあります。とても長い文です。" * draw.randint(1, 3))
        texts[i] = draw.choice(["", "  "]) + "".join(parts)
    return texts, passage


def test_passages_equal_to_brute_force(spark):
    texts, passage = made_texts(5)
    for t in texts.values():
        assert list(substring_dedup.spans_of(t, "sentence")) == brute_units(t)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for least in (1, 20, 60):
        want = brute_passages(texts, least)
        got = {}
        for r in substring_dedup.repeated_spans(docs, min_words=least).collect():
            got.setdefault(r.doc_id, []).append(r.unit)
            first = brute_units(texts[r.kept_doc_id])[r.kept_unit]
            assert brute_units(texts[r.doc_id])[r.unit][2] == first[2] and first[0] == r.kept_start and r.passage_words >= least
        assert {i: sorted(u) for i, u in got.items()} == want
        out = {r.doc_id: r.text for r in substring_dedup.drop_repeats(docs, min_words=least).collect()}
        for i, t in texts.items():
            units = brute_units(t)
            if i not in want:
                assert out[i] == t
            else:
                rest = "".join(t[a:b] for u, (a, b, _) in enumerate(units) if u not in want[i])
                assert "".join((out.get(i) or "").split()) == "".join(rest.split())
        holders = [i for i, t in texts.items() if passage in t]
        assert holders and all(passage not in out.get(i, "") for i in holders[1:]) and passage in out[holders[0]]


def test_line_ends_stay_where_units_go():
    cut = lambda text, lost: substring_dedup.without_units(text, "sentence", lost)
    assert cut("A b. C d.\nE f. G h.\n", set()) == "A b. C d.\nE f. G h.\n"
    assert cut("A b. C d.\nE f. G h.\n", {1}) == "A b.\nE f. G h.\n"
    assert cut("A b. C d.\nE f. G h.\n", {1, 2}) == "A b.\nG h.\n"
    assert cut("  A b. C d.", {0}) == "C d." and cut("A b. C d.", {1}) == "A b." and cut("A b.", {0}) == ""
    assert cut("一二。三四。五六。", {1}) == "一二。五六。"


def test_words_of_scripts_without_spaces():
    assert substring_dedup.count_words("a b c") == 3 and substring_dedup.count_words("漢字の文") == 2
    assert substring_dedup.count_words("ab 漢字 c") == 3 and substring_dedup.count_words("é") == 1


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "First  paragraph of five words\n\nOwn paragraph with words in it", 0), (2, "x\n \nFIRST paragraph of five words\n", 0)], "doc_id long, text string, n_chars long")
    rows = substring_dedup.repeated_spans(docs, unit="paragraph", min_words=5).collect()
    assert [(r.doc_id, r.unit, r.start, r.kept_doc_id) for r in rows] == [(2, 1, 4, 1)]
    assert {r.doc_id: (r.text, r.n_chars) for r in substring_dedup.drop_repeats(docs, unit="paragraph", min_words=5).collect()}[2] == ("x", 1)


# --- decontamination

ITEM = "Anna has 12 apples and gives 5 apples to her friend Boris before walking 3 km home with her brother"


def contaminated(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench).collect()}


def test_reparameterised_question_is_caught(spark):
    changed = "Today: Maria has 40 apples and gives 7 apples to her friend Peter before walking 8 miles home with her brother. More."
    same = "words before " + ITEM.upper().lower() + " words after"
    other = "Anna has many reasons to walk home and her friend Boris gives no apples to anybody at all today"
    assert contaminated(spark, [changed, same, other, None, ""], [ITEM, None, ""]) == {(0, 0), (1, 0)}


def test_slots_must_be_consistent(spark):
    item = "we asked Alice about it and then Alice told us all that Alice knew of the matter there"
    good = item.replace("Alice", "Clara")
    bad = "we asked Clara about it and then Diana told us all that Elena knew of the matter there"
    assert contaminated(spark, [good, bad], [item]) == {(0, 0)}


def test_a_clash_cuts_an_instance_and_leaves_its_parts(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    words[40] = words[60] = "12"
    copy = " ".join(words)
    edited = " ".join([*words[:60], "13", *words[61:]])
    start = "we went to the shop on the corner and bought "
    end = " each before the teacher came in and told everybody in the room to sit down and be quiet"
    shop = start + "2 pencils at 2 dollars" + end
    other = start + "3 pencils at 5 dollars" + end
    merged = shop.replace("2 pencils", "3 pencils").replace("at 2", "at 5")
    equal = shop.replace("2 pencils", "4 pencils").replace("at 2", "at 4")
    assert contaminated(spark, [edited, other], [copy, shop]) == {(0, 0), (1, 1)}
    assert contaminated(spark, [equal], [merged]) == {(0, 0)}


def test_names_that_begin_sentences_and_names_of_other_lengths(spark):
    item = "Tom has 5 apples. Ann gives him 3 more."
    changed = "Bob has 7 apples. Sue gives him 4 more."
    city = "the train from New York to the sea was late again and so we had to wait"
    assert contaminated(spark, [changed, city.replace("New York", "Paris")], [item, city]) == {(0, 0), (1, 1)}
    far = "People who moved to Rio de Janeiro said it was warm and that they liked the people they met there"
    question = "What is the capital of France?"
    texts = [far.replace("Rio de Janeiro", "Oslo"), "Question 3) What is the capital of France?", "we said nothing"]
    assert contaminated(spark, texts, [far, question]) == {(0, 0), (1, 1)}


def test_items_with_few_literals_are_found(spark):
    items = ["What is 7 times 8?", "3 km 5 kg 7 cm 9 km 4 kg 2 cm 8 km 6 kg", "Anna, Boris, Clara, Diana"]
    texts = ["so: " + x + " and on" for x in items] + ["What is 6 times 9?", "1 km 5 kg 7 cm 8 km 4 kg 3 cm 8 km 5 kg"]
    assert contaminated(spark, texts, items) == {(0, 0), (1, 1), (2, 2)}


def test_benchmark_passages_are_found(spark, documents, texts):
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")

    def words(t):
        return " ".join(re.findall(r"\w+", t.lower()))

    want = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if words(r.text) in words(t)}
    assert want and {(r.doc_id, r.item_id) for r in queries.QUERIES["op6_benchmark_decontamination"](spark, SF001).collect()} == want


def brute_contamination(text, item):
    """Covered words of the best consistent part, by all pairs of windows and all runs of matches.

    For texts of lower-case words and numbers without sentence ends.
    """
    def windows(words):
        size = min(decontaminate.WINDOW, len(item.split()))
        for at in range(len(words) - size + 1):
            run = words[at : at + size]
            slots = [w for w in run if w.isdigit()]
            few = len(run) - len(slots) < min(decontaminate.MIN_LITERALS, size)
            yield at, at + size, tuple(run) if few else tuple("#" if w.isdigit() else w for w in run), slots
    ours, theirs = list(windows(text.split())), list(windows(item.split()))
    groups, latest = [], {}
    for at, p, stop, x, y in sorted((q, p, stop, x, y) for p, _, a, x in ours for q, stop, b, y in theirs if a == b):
        for shift in sorted(range(-3, 4), key=abs):
            known = latest.get(p - at + shift)
            if known and (not shift or known[2] < p <= known[2] + at - known[1] + 3 and known[1] < at):
                number = known[0]
                break
        else:
            number = len(groups)
            groups.append([])
        latest[p - at] = number, at, p
        groups[number].append((at, stop, list(zip(x, y))))
    best = 0
    for group in groups:
        parts = [group[i:j] for i in range(len(group)) for j in range(i + 1, len(group) + 1)]
        parts.append([m for m in group if all(x == y for x, y in m[2])])
        for part in parts:
            pairs = {p for m in part for p in m[2]}
            if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                best = max(best, len({w for at, stop, _ in part for w in range(at, stop)}))
    n = len(item.split())
    return best if best >= min(decontaminate.MIN_WORDS, math.ceil(0.8 * n)) else 0


def test_contamination_equals_all_pairs_of_windows(spark):
    rng = random.Random(5)
    texts, items = [], []
    for _ in range(40):
        words = [rng.choice("aa bb cc dd ee 1 2 3".split()) for _ in range(rng.randint(1, 12))]
        item = (words * rng.randint(1, 4))[: rng.randint(3, 40)]
        items.append(" ".join(item))
        for _ in range(3):
            copy = list(item) * rng.randint(1, 2)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [rng.choice(["4", "5", "1", "bb", "zz"])]
            texts.append(" ".join(["xx"] * rng.randint(0, 3) + copy + ["yy"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered_words for r in decontaminate.find_contamination(docs, bench).collect()}
    # the size of an item's windows is its own: an item is met by texts that have windows of that size
    want = {(i, j): n for i, t in enumerate(texts) for j, x in enumerate(items) if (n := brute_contamination(t, x))}
    assert got == want and len(want) > 80


def test_long_repeats_take_no_row_for_each_pair_of_places(spark):
    one = "word " * 1500
    many = "we saw 5 of them and then we went home again " * 150
    assert contaminated(spark, [one, many.replace("5", "7"), "word " * 9], [one, many]) == {(0, 0), (1, 1)}


def test_decontamination_of_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(5, "Some plain words that make a line of text"), (6, "thing"), (None, "x")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(odd_docs, bench).collect()}
    assert {(1, 5), (2, 5), (9, 5)} <= found and not any(d is None for d, _ in found)
    kept = decontaminate.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and not {1, 2, 9} & {r.doc_id for r in kept.collect()}
    assert kept.where("doc_id is null").count() == 2
    assert decontaminate.find_contamination(no_docs, bench).count() == 0
    assert decontaminate.find_contamination(odd_docs, bench.where("item_id > 9")).count() == 0


# --- language ID

def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(150):
        languages, texts = rng.integers(1, 5), rng.integers(0, 12, size=rng.integers(1, 6))
        scores = rng.normal(size=(texts.sum(), languages)) * 3
        found, at = langid.viterbi(scores, texts, 2.0, segment=int(rng.integers(1, 5))), 0
        for n in texts:
            s, f, at = scores[at : at + n], found[at : at + n], at + n
            if n:
                best = s[0]
                for row in s[1:]:
                    best = row + np.maximum(best, best.max() - 2.0)
                assert math.isclose(s[np.arange(n), f].sum() - 2.0 * (f[1:] != f[:-1]).sum(), best.max())


def test_held_out_accuracy(spark, documents):
    rows = queries.QUERIES["op4_language_id"](spark, SF001).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_spans_of_mixed_text(spark, documents):
    model = langid.train(documents)
    parts = {lang: max((r.text for r in documents.where(f"lang = '{lang}'").collect()), key=len)[:600].rsplit(" ", 1)[0] for lang in ("en", "de")}
    mixed = parts["en"] + " " + parts["de"]
    spans = langid.label_spans(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).collect()
    letters = Counter()
    for s in spans:
        for i in range(s.start, s.end):
            letters[s.lang == ("en" if i < len(parts["en"]) else "de")] += 1
    assert letters[True] > 0.95 * letters.total()


def test_script_narrows(spark):
    rows = [(i, "привет мир как дела сегодня", "ru") for i in range(5)] + [(i + 5, "hello world how are you today", "en") for i in range(5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = spark.createDataFrame([("слово",), ("word",), ("漢字",), ("12 !",), (None,)], "text string")
    got = [(r.lang_pred, r.score) for r in langid.predict(texts, model).collect()]
    assert got == [("ru", 1.0), ("en", 1.0), ("en", 0.0), ("und", 0.0), ("und", 0.0)]


def test_language_of_odd_rows(odd_docs, no_docs):
    model = langid.train(odd_docs)
    out = langid.predict(odd_docs, model)
    assert sorted(out.columns) == sorted([*odd_docs.columns, "lang_pred"])
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in out.collect())
    assert langid.predict(no_docs, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, langid.train(no_docs)).collect()} == {"und"}
    assert langid.label_spans(odd_docs, model).count() > 0


# --- Lempel-Ziv fingerprints

def brute_phrases(text):
    found, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in found:
            found.add(phrase)
            phrase = ""
    return found


def test_neighbours_equal_brute_force(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(lz_fingerprint, "chunk_count", lambda df, column: 7)
    rows = {r.doc_id: r for r in lz_fingerprint.compare_neighbours(documents).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for i, following in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, tail, r = texts[i], len(texts[i]) // 4, rows[i]
        edited = text[: len(text) - tail] + texts[following][:tail]
        a, b, c = (brute_phrases(t) for t in (text, edited, texts[following]))
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == lz_fingerprint.to_string(lz_fingerprint.sketch_of(text))
        assert r.edited_fingerprint == lz_fingerprint.to_string(lz_fingerprint.sketch_of(edited))
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.25 and abs(r.near_next - len(a & c) / len(a | c)) < 0.25


def test_likeness_is_exact_for_small_sets():
    rng = random.Random(4)
    for _ in range(30):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 150))) for _ in range(2))
        x, y = brute_phrases(a), brute_phrases(b)
        want = len(x & y) / len(x | y) if x | y else 1.0
        assert math.isclose(lz_fingerprint.likeness(lz_fingerprint.sketch_of(a), lz_fingerprint.sketch_of(b)), want)
    sketch = lz_fingerprint.sketch_of("abcabc")
    assert (lz_fingerprint.from_string(lz_fingerprint.to_string(sketch)) == sketch).all()


def test_fingerprints_of_odd_rows(spark, odd_docs, no_docs):
    rows = lz_fingerprint.compare_neighbours(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    by_text = {}
    for r in lz_fingerprint.fingerprints(odd_docs).collect():
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by_text[3] == by_text[4] == {""} and len(by_text[9]) == 2 and len(by_text[8]) == 1
    assert lz_fingerprint.compare_neighbours(no_docs).count() == 0
    alone = lz_fingerprint.compare_neighbours(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abca").hexdigest() and alone[0].near_next == 1.0


# --- language model

def brute_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_language_model_query(spark, documents, texts):
    rows = queries.QUERIES["op2_lm_scoring"](spark, SF001).collect()
    assert len(rows) == len(texts)
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(brute_tokens(t))
    total, distinct = counts.total(), len(counts)
    for r in rows:
        tokens = brute_tokens(texts[r.doc_id])
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    model = maxent_lm.Model([rng.normal(size=(1 << maxent_lm.HASH_BITS, n)).astype(np.float32) for n in (maxent_lm.CLASSES, maxent_lm.GROUPS)])
    batch = maxent_lm.Batch(maxent_lm.Tokens(["a few words of text", "", None, "more words"]))
    for which, (context, rows, _) in enumerate(batch.softmaxes):
        outcomes, total = model.exponentials(which, context, rows)
        assert np.allclose((outcomes / total).sum(axis=1), 1, atol=1e-4) and np.isfinite(total).all()


def test_gradient_steps_raise_the_likelihood():
    model, batch = maxent_lm.Model(), maxent_lm.Batch(maxent_lm.Tokens(["the cat sat on the mat", "the dog sat on the rug"] * 40))
    before = model.log10(batch).sum()
    for _ in range(60):
        model.step(batch)
    assert model.log10(batch).sum() > 0.3 * before


def test_twenty_steps_learn_the_word_pairs():
    model, batch = maxent_lm.Model(), maxent_lm.Batch(maxent_lm.Tokens(["the cat sat on the mat", "the dog sat on the rug"] * 40))
    before = model.log10(batch).sum()
    for _ in range(20):
        model.step(batch)
    assert model.log10(batch).sum() > 0.2 * before


def test_word_pairs_are_features():
    """The word after next tells nothing alone, nor the one before: the two together do."""
    rng = random.Random(8)
    pairs = [rng.choice(("ab", "ba", "aa", "bb")) for _ in range(4000)]
    texts = [f"{'q' if x == 'a' else 'r'}xx {'q' if y == 'a' else 'r'}xx {'le' if x == y else 'on'}" for x, y in pairs]
    model, batch = maxent_lm.Model(), maxent_lm.Batch(maxent_lm.Tokens(texts))
    assert maxent_lm.class_of(b"le") != maxent_lm.class_of(b"on")
    for _ in range(60):
        model.step(batch)
    outcomes, total = model.exponentials(0, *batch.softmaxes[0][:2])
    third = np.arange(2, len(total), 4)
    assert ((outcomes / total)[third, batch.softmaxes[0][2][third]] > 0.8).all()


def test_tokens_equal_brute_force():
    rng = random.Random(6)
    texts = ["".join(rng.choice("aAbzÉé \t\n\x0b\x1c\xa0漢.") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", " \n", "x" * 64, "x" * 65, "x" * 5000 + " " + "x" * 5001, "a", "ab"]
    tokens = maxent_lm.Tokens(texts, check=True)
    want = [brute_tokens(t) for t in texts]
    assert tokens.sizes.tolist() == [len(t) for t in want]
    names: dict = {}
    for i, word in enumerate(w for t in want for w in t):
        raw = (word or "").encode()
        assert names.setdefault(word, (tokens.word[i], tokens.check[i])) == (tokens.word[i], tokens.check[i])
        assert (tokens.word[i] == 0) == (word is None)
        assert (tokens.classes[i], tokens.groups[i]) == (maxent_lm.class_of(raw[-2:]), maxent_lm.group_of(raw[:2]))
    assert len(set(names.values())) == len(names)


def test_language_model_of_odd_rows(odd_docs, no_docs):
    rows = maxent_lm.score_texts(odd_docs, odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert maxent_lm.score_texts(no_docs, odd_docs).count() == 0
    unseen = maxent_lm.score_texts(odd_docs, no_docs).collect()
    assert {(r.n_known, r.train_tokens) for r in unseen} == {(0, 0)} and all(math.isfinite(r.score) for r in unseen)


def test_score_is_that_of_the_weights(spark, documents):
    """Token by token from the trained weights: features, both softmaxes and the share of the group."""
    training = documents.where("doc_id % 3 = 0")
    texts = ["The house, the HOUSE and the", "", None, "a b  a", "zzqq é の " + "x" * 80] + [r.text for r in training.limit(3).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = maxent_lm.train(training).weights
    mix, classes, groups = maxent_lm._mix, maxent_lm.CLASSES, maxent_lm.GROUPS

    def tokens(text):
        words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]
        return [w.encode() for w in words] + [b""]

    counts = Counter(t for r in training.collect() for t in tokens(r.text))
    cell = lambda t: (maxent_lm.class_of(t[-2:]), maxent_lm.group_of(t[:2]))
    seen, distinct = Counter(), Counter()
    for t, n in counts.items():
        seen[cell(t)] += n
        distinct[cell(t)] += 1

    def log10_softmax(table, rows, target):
        logits = sum(table[int(r)].astype(float) for r in rows)
        return (logits[target] - math.log(np.exp(logits).sum())) / math.log(10)

    def brute(text):
        total, w1, w2, k = 0.0, 1, 1, [classes] * 3
        hashes = {t: int(maxent_lm.Tokens([t.decode()]).word[0]) if t else 0 for t in tokens(text)}
        for t in tokens(text):
            c, g = cell(t)
            of_class = [mix([np.array([x]) if i else x for i, x in enumerate(f)])[0] for f in ([1, k[0]], [2, k[0], k[1]], [3, *k], [4, k[1], k[2]])]
            of_group = [mix([np.array([x]) if i else x for i, x in enumerate(f)])[0] for f in ([5, c], [6, k[0], c], [7, k[0], k[1], c])]
            u1, u2 = np.array([w1], np.uint64), np.array([w2], np.uint64)
            of_class += [mix([11, u1])[0], mix([12, u1, u2])[0], mix([13, u2])[0]]
            of_group += [mix([14, u1, np.array([c])])[0], mix([15, u1, u2, np.array([c])])[0]]
            total += log10_softmax(weights[0], of_class, c) + log10_softmax(weights[1], of_group, g)
            total += math.log10((counts[t] + 0.5) / (seen[c, g] + 0.5 * (distinct[c, g] + 1)))
            w1, w2, k = hashes[t], w1, [c, *k[:2]]
        return total

    got = {r.doc_id: r.score for r in maxent_lm.score_texts(docs, training).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert math.isclose(got[i], brute(text), rel_tol=1e-4, abs_tol=1e-3), (i, got[i], brute(text))


def test_sums_of_gradients_by_number():
    rng = np.random.default_rng(3)
    for n in (1, 7, 300, 5000):
        index, values = rng.integers(0, rng.integers(1, 400), size=3 * n), rng.normal(size=(n, 4))
        number, total = maxent_lm.sum_by(index, values)
        want = np.zeros((400, 4))
        np.add.at(want, index, np.tile(values, (3, 1)))
        assert sorted(number) == sorted(set(index.tolist())) and np.allclose(want[number], total)


def test_equal_items_are_matched_once(spark, monkeypatch):
    texts = {1: "Tom has 5 apples and gives 3 of them to his old friend Ann before the long walk home", 2: "a second item that stands alone with words of its own and a few more of them here", 3: None}
    bench = spark.createDataFrame([(i + 10 * k, t) for i, t in texts.items() for k in range(6)] + [(1, texts[1]), (None, texts[1]), (99, texts[1]), (99, texts[2])], "item_id long, text string")
    docs = spark.createDataFrame([(5, "He said so. " + texts[1].replace("5", "8") + " again."), (6, texts[2]), (7, "nothing of that kind")], "doc_id long, text string")
    met, windows = [], decontaminate.benchmark_windows

    def counted(rows, *args):
        met.append(sorted(r[0] for r in rows.select("item_id").collect()))
        return windows(rows, *args)

    monkeypatch.setattr(decontaminate, "benchmark_windows", counted)
    found = {(r.doc_id, r.item_id): r[2:] for r in decontaminate.find_contamination(docs, bench).collect()}
    assert met == [[1, 2, 99, 99]]
    assert {k for k in found if k[1] != 99} == {(5, 1 + 10 * k) for k in range(6)} | {(6, 2 + 10 * k) for k in range(6)}
    assert len({found[5, 1 + 10 * k] for k in range(6)}) == len({found[6, 2 + 10 * k] for k in range(6)}) == 1
    assert {(5, 99), (6, 99)} <= set(found)

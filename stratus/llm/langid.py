"""Language identification of mixed-language text.

Method: the script of a word (code point ranges) narrows the languages that it may be in.  A
character model of each language (four characters, interpolated with shorter contexts) scores
every word.  Viterbi over the word scores of a text, with a penalty for every switch of language,
labels spans; a document gets the language that most of its letters are in.

Training takes a bounded, documented sample: about ``SAMPLE_DOCS`` labelled documents of each
language, chosen by a hash of their id.  Counts are summed by Spark into tables of fixed size.

Scale: prediction is a narrow map over whole texts, no shuffle.  Word scores are kept per task
(``CACHE_WORDS``), and Viterbi runs over many texts at once: long texts are cut into segments
whose best scores are found for every state they may be entered in, and then linked, which gives
exactly the path of the whole text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import add_columns, map_rows, ship_by_value

ship_by_value(__name__)

SAMPLE_DOCS = 2000
MAX_LANGUAGES = 200
SWITCH_PENALTY = 10.0
ORDER = 4
BUCKET_BITS = 16
BACKOFF = 4.0
CACHE_WORDS = 150_000
SEGMENT_WORDS = 128
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")

#: fixed values: first code point of each range and its script ("" for none of these)
SCRIPT_RANGES = [
    (0x0000, ""), (0x0041, "Latin"), (0x0250, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Hiragana"),
    (0x30A0, "Katakana"), (0x3100, ""), (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, ""), (0x20000, "Han"), (0x2FA20, ""),
]
STARTS = np.array([s for s, _ in SCRIPT_RANGES])
SCRIPTS = sorted({n for _, n in SCRIPT_RANGES})
SCRIPT_OF_RANGE = np.array([SCRIPTS.index(n) for _, n in SCRIPT_RANGES])


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all characters of the words (and one end each): buckets of the ``1 .. ORDER`` last characters
    and of the contexts before them; the word each belongs to; the words' scripts and letters."""
    joined = "".join("\x02" * (ORDER - 1) + w.lower() + "\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    is_end, is_pad = codes == 3, codes == 2
    word = np.cumsum(is_end) - is_end
    at = np.flatnonzero(~is_pad)
    grams, contexts = [], []
    for k in range(1, ORDER + 1):
        gram, context = np.full(len(at), np.uint64(k)), np.full(len(at), np.uint64(k + 100))
        for back in range(k):
            part = codes[at - back]
            gram = (gram ^ part) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(31)
            if back:
                context = (context ^ part) * np.uint64(0x9E3779B97F4A7C15)
                context ^= context >> np.uint64(31)
        grams.append((gram >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        contexts.append((context >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) if k > 1 else np.zeros(len(at), dtype=np.int64))
    letters = np.array([sum(map(str.isalpha, w)) for w in words], dtype=np.int64)
    first = np.array([ord(next(filter(str.isalpha, w), "\0")) for w in words], dtype=np.int64)
    scripts = SCRIPT_OF_RANGE[np.searchsorted(STARTS, first, side="right") - 1]
    return np.stack(grams), np.stack(contexts), word[at], scripts, letters


class LanguageModel:
    """``languages``; counts by (order, language, bucket) of grams and contexts; ``allowed[script, language]``."""

    def __init__(self, languages: list[str], grams: np.ndarray, contexts: np.ndarray, allowed: np.ndarray):
        self.languages, self.grams, self.contexts, self.allowed = languages, grams, contexts, allowed

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each word in each language (zeros where its script rules out all), and its
        letters that tell a language."""
        grams, contexts, word, scripts, letters = word_features(words)
        p = np.full((grams.shape[1], len(self.languages)), 1.0 / (1 << 10), dtype=np.float32)
        for k in range(ORDER):
            p = (self.grams[k][:, grams[k]].T + BACKOFF * p) / (self.contexts[k][:, contexts[k]].T + BACKOFF)
        total = np.add.reduceat(np.log(p), np.flatnonzero(np.append(True, word[1:] != word[:-1])), axis=0)
        allowed = self.allowed[scripts]
        open_ = allowed.any(axis=1)
        total = np.where(allowed, total, -1e4)
        total[~open_ | (letters == 0)] = 0
        return total.astype(np.float32), np.where(open_, letters, 0)


def train(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Fit on labelled rows of ``docs`` (the caller leaves out what is held out).

    About ``sample_docs`` documents of each language are taken, by a hash of id and label; rows with
    a null label or text are not.  No labelled rows give a model without languages.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    shape = (ORDER, len(languages), 1 << BUCKET_BITS)
    grams, contexts, allowed = np.zeros(shape, np.float32), np.zeros(shape, np.float32), np.zeros((len(SCRIPTS), len(languages)))
    if not languages:
        return LanguageModel([], grams, contexts, allowed.astype(bool))
    share = F.create_map(*[x for n in languages for x in (F.lit(n), F.lit(min(1.0, sample_docs / sizes[n])))])
    drawn = F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 20)) < F.lit(1 << 20) * share[F.col("lang")]

    def count():
        def fn(columns):
            cells: dict[tuple[int, int], np.ndarray] = {}
            for lang, text in zip(*columns, strict=True):
                words = WORD.findall(text)
                if not words:
                    continue
                g, c, word, scripts, letters = word_features(words)
                number = languages.index(lang)
                for k in range(ORDER):
                    for kind, buckets in ((k, g[k]), (ORDER + k, c[k])):
                        cells.setdefault((number, kind), []).append(buckets)
                cells.setdefault((number, 2 * ORDER), []).append(np.repeat(scripts, letters))
            out = []
            for (number, kind), found in cells.items():
                bucket, n = np.unique(np.concatenate(found), return_counts=True)
                out.append((np.full(len(bucket), number), np.full(len(bucket), kind), bucket, n))
            return [np.concatenate(x).tolist() for x in zip(*out, strict=True)] if out else [[], [], [], []]

        return fn

    counted = map_rows(rows.where(drawn).select("lang", "text"), count, "lang int, kind int, bucket int, n long")
    # at most one row per cell of the tables, whose size is fixed
    for number, kind, bucket, n in counted.groupBy("lang", "kind", "bucket").agg(F.sum("n")).toLocalIterator():
        if kind < ORDER:
            grams[kind, number, bucket] = n
        elif kind < 2 * ORDER:
            contexts[kind - ORDER, number, bucket] = n
        else:
            allowed[bucket, number] = n
    return LanguageModel(languages, grams, contexts, allowed >= np.maximum(1, 0.01 * allowed.sum(axis=0)))


def viterbi(scores: np.ndarray, texts: np.ndarray, penalty: float = SWITCH_PENALTY, segment: int = SEGMENT_WORDS) -> np.ndarray:
    """Best language of each word.  ``scores`` (words x languages) of many texts in a row, ``texts`` the
    words of each.  A path scores the sum of its word scores less ``penalty`` for every switch."""
    n, languages = scores.shape
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    texts = texts[texts > 0]
    parts = -(-texts // segment)  # segments of each text
    of_text = np.repeat(np.arange(len(texts)), parts)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(segment, texts[of_text] - number * segment)
    begin = np.repeat(np.cumsum(texts) - texts, parts) + number * segment
    order = np.argsort(-size, kind="stable")  # longest first: those that a step touches lie in front
    size, begin, number, of_text = size[order], begin[order], number[order], of_text[order]
    steps = int(size[0])
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]  # segments with more than t words
    # best score of every segment from each state it is entered in to each state it is left in
    through = np.where(np.eye(languages, dtype=bool), 0, -np.inf)[None].repeat(len(size), axis=0)
    for t in range(steps):
        m = through[: active[t]]
        through[: active[t]] = scores[begin[: active[t]] + t][:, None, :] + np.maximum(m, m.max(axis=2, keepdims=True) - penalty)
    entered = np.zeros((len(size), languages))  # best score of each state before a segment
    at = np.zeros((len(texts), int(parts.max())), dtype=np.int64)
    at[of_text, number] = np.arange(len(size))
    for k in range(1, at.shape[1]):
        many = np.flatnonzero(parts > k)
        before = at[many, k - 1]
        entered[at[many, k]] = (entered[before][:, :, None] + through[before]).max(axis=1)
    stays = np.zeros((steps, len(size), languages), dtype=bool)
    best_from = np.zeros((steps, len(size)), dtype=np.int64)
    value = entered.copy()
    for t in range(steps):
        v = value[: active[t]]
        top = v.argmax(axis=1)
        switch = np.take_along_axis(v, top[:, None], axis=1) - penalty
        stays[t, : active[t]], best_from[t, : active[t]] = v >= switch, top
        value[: active[t]] = scores[begin[: active[t]] + t] + np.maximum(v, switch)
    # path of every segment for each state it is left in, from its end back
    path = np.zeros((steps, len(size), languages), dtype=np.int16)
    state = np.tile(np.arange(languages), (len(size), 1))
    for t in range(steps - 1, -1, -1):
        s = state[: active[t]]
        path[t, : active[t]] = s
        state[: active[t]] = np.where(np.take_along_axis(stays[t, : active[t]], s, axis=1), s, best_from[t, : active[t], None])
    left = np.zeros(len(size), dtype=np.int64)
    last = at[np.arange(len(texts)), parts - 1]
    left[last] = value[last].argmax(axis=1)
    for k in range(at.shape[1] - 2, -1, -1):
        many = np.flatnonzero(parts > k + 1)
        after = at[many, k + 1]
        left[at[many, k]] = state[after, left[after]]
    found = np.zeros(n, dtype=np.int64)
    for t in range(steps):
        found[begin[: active[t]] + t] = path[t, np.arange(active[t]), left[: active[t]]]
    return found


class Labeller:
    """Labels the words of texts; keeps the scores of words it has met."""

    def __init__(self, model: LanguageModel, penalty: float):
        self.model, self.penalty = model, penalty
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text -> language number and letters of every word, all texts in a row."""
        words = [w for t in texts for w in t]
        if len(self.row) > CACHE_WORDS:
            self.clear()
        new = list(dict.fromkeys(w for w in words if w not in self.row))
        if new:
            scores, letters = self.model.scores(new)
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        return viterbi(self.scores[rows], np.array([len(t) for t in texts]), self.penalty), self.letters[rows]


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs`` (all rows and columns) with ``lang_pred`` and ``score``.

    ``lang_pred`` is the language of most letters (ties: the first by name), ``score`` its share of
    all letters; both columns replace ones of that name.  ``und`` with score 0: null or empty text, no
    letter, or a model without languages.  Letters whose script no language has count for no language;
    a text of them alone gets the first language, with score 0.
    """
    names = model.languages

    def label():
        labeller = Labeller(model, penalty)

        def fn(strings):
            texts = [WORD.findall(t) if t else [] for t in strings]
            lettered = [any(map(str.isalpha, "".join(t))) for t in texts]
            if not names:
                return [[UNDETERMINED] * len(texts), [0.0] * len(texts)]
            found, letters = labeller(texts)
            doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            weight = np.bincount(doc * len(names) + found, weights=letters, minlength=len(texts) * len(names)).reshape(len(texts), len(names))
            total, top = weight.sum(axis=1), weight.argmax(axis=1)
            share = weight.max(axis=1) / np.maximum(total, 1)
            return [[names[i] if any_ else UNDETERMINED for i, any_ in zip(top, lettered, strict=True)], np.where(lettered, share, 0.0).tolist()]

        return fn

    return add_columns(docs, text_col, label, "lang_pred string, score double")


def label_spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``(doc_id, start, end, lang)``: the spans of each text, from its first word in a language to the
    last before another; code points.  Texts without words, and models without languages, give no rows."""
    names = model.languages

    def cut():
        labeller = Labeller(model, penalty)

        def fn(columns):
            out: list[list] = [[], [], [], []]
            if not names:
                return out
            places = [[(m.start(), m.end(), m[0]) for m in WORD.finditer(t)] if t else [] for t in columns[1]]
            found, _ = labeller([[w for _, _, w in p] for p in places])
            at = 0
            for doc_id, place in zip(columns[0], places, strict=True):
                langs, at = found[at : at + len(place)], at + len(place)
                turns = np.flatnonzero(np.diff(langs)) + 1
                for a, b in zip([0, *turns], [*turns, len(place)], strict=True):
                    if b > a:
                        for column, value in zip(out, (doc_id, place[a][0], place[b - 1][1], names[langs[a]]), strict=True):
                            column.append(value)
            return out

        return fn

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, cut, "doc_id long, start int, end int, lang string")

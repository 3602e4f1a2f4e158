"""Language-model scoring with a hashed maximum-entropy model.

Method: the probability of a token is that of its class given the tokens before it, times that of
its group within the class given the same, times its share of the group.  Both softmaxes are
maximum-entropy models over hashed features: n-grams of words and of classes, and skip features.
The share within a group is the smoothed count of the word, the maximum-entropy solution for
word indicators.  Class and group come from the ends of a word, so that an unseen word has them.
A word is named by 96 bits of hashes, computed for all words of many texts at once.

Training is distributed gradient descent: in every round the tasks start from the same weights,
take gradient steps over their documents, and what they changed is summed by Spark and averaged.
Each training document takes part in one round.  Scoring runs on sparse numpy batches.

Scale: weights have a fixed size (``2 ** HASH_BITS`` rows), whatever the corpus.  Word counts are a
table that grows with the corpus and is never collected or broadcast: documents are dealt into
chunks of bounded size, each chunk's distinct words are joined with the counts, and the chunk
is scored against them.  A frequent word has one row per chunk at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import MOST_CHUNKS, SLICE_ROWS, bound_batches, chunk_count, shared_table, ship_by_value

ship_by_value(__name__)

CLASSES = 16
GROUPS = 16
#: 16 at most
HASH_BITS = 15
ROUNDS = 3
RATE = 0.1
BATCH_TOKENS = 1 << 14
#: rows of one number that are added one by one
FEW = 8
#: raw bytes of a chunk: larger chunks repeat fewer words
CHUNK_BYTES = 16 << 20
#: tokens whose distinct words a task sends together
COUNT_TOKENS = 1 << 21
#: the longest word whose hash is a sum over its bytes
LONG_WORD = 64


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def class_of(end: bytes) -> int:
    """Class of a word from its last two bytes (the end of a text, an empty word, is class 0)."""
    return 1 + zlib.crc32(end) % (CLASSES - 1) if end else 0


def group_of(start: bytes) -> int:
    """Group of a word from its first two bytes."""
    return zlib.crc32(start) // 7 % GROUPS if start else 0


def _by_two_bytes(name: Callable[[bytes], int]) -> np.ndarray:
    """``name`` of all two bytes, then of all single ones."""
    return np.array([name(bytes(divmod(i, 256))) for i in range(1 << 16)] + [name(bytes([i])) for i in range(256)], dtype=np.int16)


CLASS, GROUP = _by_two_bytes(class_of), _by_two_bytes(group_of)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_RNG = np.random.default_rng(71)
#: two independent hashes of a word: random values of its bytes times powers of an odd number
BYTE_VALUES = np.where(SPACE, np.uint64(0), _RNG.integers(1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.repeat(_RNG.integers(1 << 60, size=(2, 1), dtype=np.uint64) * np.uint64(8) + np.uint64(5), LONG_WORD, axis=1), axis=1)


class Tokens:
    """The tokens of texts in a row: words between ASCII white space, A-Z in lower case, and one end each.

    ``word`` and ``check`` are 64-bit hashes (0 for an end); together they stand for the word, and
    ``check`` is made on demand only.  ``sizes`` are the tokens of each text.  A null text counts as empty.
    """

    def __init__(self, texts: Sequence[str | None], check: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        turns = np.flatnonzero(np.diff(~SPACE[data], prepend=False))
        start, end = turns[::2], turns[1::2]  # the last byte is white space
        size = end - start
        text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")
        self.sizes = np.bincount(text, minlength=len(raw)) + 1
        total = len(start) + len(raw)
        place = np.arange(len(start)) + text  # an end follows the words of each text
        self.word, self.check = np.zeros(total, dtype=np.uint64), np.zeros(total if check else 0, dtype=np.uint64)
        self.classes, self.groups = np.zeros((2, total), dtype=np.int64)
        if not len(start):
            return
        # from each word's start to the next: white space adds nothing to the sums
        body = data[start[0] :]
        begin = (start - start[0]).astype(np.int32)
        offset = np.arange(len(body), dtype=np.int32) - np.repeat(begin, np.diff(begin, append=np.int32(len(body))))
        np.minimum(offset, LONG_WORD - 1, out=offset)
        long = [(k, xxhash.xxh3_128_intdigest(data[start[k] : end[k]].tobytes())) for k in np.flatnonzero(size > LONG_WORD).tolist()]
        for i, into in enumerate((self.word, self.check)[: 1 + check]):
            found = np.add.reduceat(BYTE_VALUES[i][body] * POWERS[i][offset], begin)
            for k, digest in long:
                found[k] = digest >> 64 * i & 0xFFFFFFFFFFFFFFFF
            found ^= found >> np.uint64(32)
            found *= np.uint64(0xD6E8FEB86659FD93)
            into[place] = (found ^ (found >> np.uint64(29))) | np.uint64(1)  # never an end's
        one = size == 1
        first, last = data[start].astype(np.int64), data[end - 1].astype(np.int64)
        self.classes[place] = CLASS[np.where(one, 65536 + first, data[end - 2].astype(np.int64) * 256 + last)]
        self.groups[place] = GROUP[np.where(one, 65536 + first, first * 256 + data[start + 1 - one])]


def _mix(parts: list[np.ndarray | int]) -> np.ndarray:
    """Row of the weight table for a feature named by numbers."""
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for part in parts:
            total = (total ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(32)
        return ((total * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _class_contexts() -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class features for every context of classes: three before (for the class), two
    before and the class itself (for the group)."""
    a, b, c = (x.ravel() for x in np.indices((CLASSES + 1,) * 3))
    of_class = np.stack([_mix([1, a]), _mix([2, a, b]), _mix([3, a, b, c]), _mix([4, b, c])])
    a, b, c = (x.ravel() for x in np.indices((CLASSES + 1, CLASSES + 1, CLASSES)))
    return of_class, np.stack([_mix([5, c]), _mix([6, a, c]), _mix([7, a, b, c])])


def sum_by(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers (under 65,536), those with more rows first, and the sum of their rows; ``values`` repeat for a longer index."""
    order = np.argsort(index.astype(np.uint16), kind="stable")  # a radix sort
    ordered = index.take(order)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    many = np.diff(first, append=len(ordered))
    by_size = np.argsort((FEW + 1 - np.minimum(many, FEW + 1)).astype(np.uint8), kind="stable")
    first, many = first.take(by_size), many.take(by_size)
    rows = order % len(values)
    total = values.take(rows.take(first), axis=0)
    # the second of all numbers that have one, then the third: most numbers have a few rows
    for k in range(1, FEW):
        total[: (n := np.count_nonzero(many > k))] += values.take(rows.take(first[:n] + k), axis=0)
    if n := np.count_nonzero(many > FEW):
        left = many[:n] - FEW
        begin = np.cumsum(left) - left
        rest = np.arange(left.sum()) + np.repeat(first[:n] + FEW - begin, left)
        total[:n] += np.add.reduceat(values.take(rows.take(rest), axis=0), begin, axis=0)
    return ordered.take(first), total


class Batch:
    """Features of many tokens: for each softmax a context of classes and rows of word features."""

    def __init__(self, tokens: Tokens):
        hashes, classes, groups, sizes = tokens.word, tokens.classes, tokens.groups, tokens.sizes
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        before = [place < back for back in (1, 2, 3)]  # the context would lie before the text
        w1, w2 = (np.where(e, np.uint64(1), np.roll(hashes, i + 1)) for i, e in enumerate(before[:2]))
        k1, k2, k3 = (np.where(e, CLASSES, np.roll(classes, i + 1)) for i, e in enumerate(before))
        side = CLASSES + 1
        # n-grams w1 and w2 w1, and the skip of one word, beside the n-grams and skips of classes
        self.softmaxes = (
            ((k1 * side + k2) * side + k3, [_mix([11, w1]), _mix([12, w1, w2]), _mix([13, w2])], classes),
            ((k1 * side + k2) * CLASSES + classes, [_mix([14, w1, classes]), _mix([15, w1, w2, classes])], groups),
        )


class Model:
    """Weights of the class softmax and of the group softmax."""

    def __init__(self, weights: list[np.ndarray] | None = None):
        size = 1 << HASH_BITS
        self.weights = weights or [np.zeros((size, CLASSES), np.float32), np.zeros((size, GROUPS), np.float32)]
        self.squares = [np.ones_like(w) for w in self.weights]
        self.contexts = _class_contexts()
        self.summed: list[np.ndarray | None] = [None, None]  # logits of the contexts under the present weights

    def exponentials(self, which: int, context: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token's outcomes, and their sum."""
        weights = self.weights[which]
        if self.summed[which] is None:  # once for each context, not for each token
            self.summed[which] = sum(weights.take(r, axis=0) for r in self.contexts[which])
        logits = self.summed[which].take(context, axis=0)
        for r in rows:
            logits += weights.take(r, axis=0)
        np.clip(logits, -40, 40, out=logits)
        np.exp(logits, out=logits)
        return logits, logits @ np.ones((logits.shape[1], 1), np.float32)

    def update(self, which: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Change distinct ``rows``; each weight's rate falls with the gradients it has met."""
        squares = self.squares[which].take(rows, axis=0) + gradient * gradient
        self.squares[which][rows] = squares
        self.weights[which][rows] = self.weights[which].take(rows, axis=0) - np.float32(RATE) * gradient / np.sqrt(squares)
        self.summed[which] = None

    def step(self, batch: Batch) -> None:
        """A gradient step of both softmaxes."""
        for which, (context, rows, target) in enumerate(batch.softmaxes):
            error, total = self.exponentials(which, context, rows)
            error /= total
            error[np.arange(len(target)), target] -= 1
            used, summed = sum_by(context, error)
            of_contexts = sum_by(np.concatenate([r[used] for r in self.contexts[which]]), summed)
            of_words = sum_by(np.concatenate(rows), error)
            self.update(which, *sum_by(*(np.concatenate(x) for x in zip(of_contexts, of_words, strict=True))))

    def log10(self, batch: Batch) -> np.ndarray:
        """Log10 probability of each token's class and group."""
        total = np.zeros(len(batch.softmaxes[0][2]))
        for which, (context, rows, target) in enumerate(batch.softmaxes):
            outcomes, normal = self.exponentials(which, context, rows)
            total += np.log10(outcomes[np.arange(len(target)), target] / normal[:, 0])
        return total


def _batches(texts: Iterator[str | None], check: bool = False, most_bytes: int = 6 * BATCH_TOKENS) -> Iterator[Tokens]:
    """Tokens of about ``most_bytes`` bytes of texts at a time, or of one longer text."""
    held: list[str | None] = []
    size = 0
    for text in texts:
        n = len(text or "") + 1
        if held and size + n > most_bytes:
            yield Tokens(held, check)
            held, size = [], 0
        held.append(text)
        size += n
    if held:
        yield Tokens(held, check)


def _strings(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[str | None]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield from batch.column(column).slice(start, SLICE_ROWS).to_pylist()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Fit the class and group softmaxes on all rows of ``docs`` (the caller leaves out what is held out).

    A null text is one end; no rows leave all weights at zero (uniform softmaxes).
    """
    spark = docs.sparkSession
    model = Model()
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(rounds)).alias("round"))
    # a few longer tasks instead of many short ones: what they send grows with their number
    tasks = 2 * spark.sparkContext.defaultParallelism
    names = [f"w{i}" for i in range(max(CLASSES, GROUPS))]

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Model([w.copy() for w in model.weights]), 0
        for tokens in _batches(_strings(batches)):
            own.step(Batch(tokens))
            seen += len(tokens.word)
        for which, (before, after) in enumerate(zip(model.weights, own.weights, strict=True)):
            change = after - before
            row = np.flatnonzero(change.any(axis=1))
            width = change.shape[1]
            columns = [change[row, i] if i < width else np.zeros(len(row), np.float32) for i in range(len(names))]
            fixed = [np.full(len(row), which, np.int32), row.astype(np.int32), np.full(len(row), seen, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in fixed + columns], names=["which", "row", "n", *names])

    for number in range(rounds):
        part = rows.where(F.col("round") == number).select("text").coalesce(tasks)
        changes = bound_batches(part).mapInArrow(gradients, "which int, row int, n long, " + ", ".join(f"{c} float" for c in names))
        mean = changes.groupBy("which", "row").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in names]).toPandas()  # two tables of fixed size at most
        for which, weights in enumerate(model.weights):
            own = mean[mean["which"] == which]
            weights[own["row"].to_numpy()] += own[names[: weights.shape[1]]].to_numpy(np.float32)
    return model


def distinct_words(tokens: Iterable[Tokens]) -> dict[str, np.ndarray]:
    """``word, check, cell, n`` of the distinct words (32 bits of the second hash do beside 64 of the
    first); a cell is a class and group."""
    words, checks, cells = (
        np.concatenate(x)
        for x in zip(*((t.word, t.check, (t.classes * GROUPS + t.groups).astype(np.int32)) for t in tokens), strict=True)
    )
    order = np.argsort(words)
    ordered = words[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    kept = order[first]
    n = np.diff(np.append(first, len(ordered)))
    return {"word": ordered[first].view(np.int64), "check": (checks[kept] >> np.uint64(32)).astype(np.uint32).view(np.int32), "cell": cells[kept], "n": n}


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, check, cell, n)`` over all texts: how often each word, named by its two hashes, occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Tokens] = []
        for tokens in _batches(_strings(batches), check=True):
            held.append(tokens)
            if sum(len(t.word) for t in held) >= COUNT_TOKENS:
                yield pa.RecordBatch.from_pydict(distinct_words(held))
                held = []
        if held:
            yield pa.RecordBatch.from_pydict(distinct_words(held))

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    found = bound_batches(rows).mapInArrow(count, "word long, check int, cell int, n long")
    return found.groupBy("word", "check").agg(F.min("cell").alias("cell"), F.sum("n").alias("n"))


def group_totals(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of every (class, group)."""
    tokens, distinct = np.zeros((2, CLASSES * GROUPS), dtype=np.int64)
    for cell, n, v in counts.groupBy("cell").agg(F.sum("n"), F.count(F.lit(1))).collect():  # one row per cell at most
        tokens[cell], distinct[cell] = n, v
    return tokens, distinct


def score_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    ``base_score`` is the log10 probability of the text's tokens by smoothed counts alone, ``score``
    that of the model; both learn from ``training`` only.  A null text counts as empty (one end).
    Repeated rows are scored each; no rows give no rows.  Other columns are not looked at.
    """
    counts = shared_table(word_counts(training, text_col), "counts")
    cell_tokens, cell_words = group_totals(counts)
    total, distinct = int(cell_tokens.sum()), int(cell_words.sum())
    model = train(training, id_col, text_col, rounds)
    base_norm = np.log10(total + 0.5 * (distinct + 1))
    cell_norm = np.log10(cell_tokens + 0.5 * (cell_words + 1))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = chunk_count(rows, "text", CHUNK_BYTES)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(min(chunks, MOST_CHUNKS), "chunk")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct words of every chunk; a chunk's texts may come in several runs."""
        held: dict[int, list[Tokens]] = {}

        def pack() -> Iterator[pa.RecordBatch]:
            for chunk, tokens in held.items():
                found = distinct_words(tokens)
                yield pa.RecordBatch.from_pydict({"chunk": np.full(len(found["word"]), chunk), "word": found["word"], "check": found["check"]})
            held.clear()

        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                chunks, strings = part.column("chunk").to_numpy(), part.column("text").to_pylist()
                for chunk in np.unique(chunks).tolist():
                    tokens = Tokens([t for t, c in zip(strings, chunks, strict=True) if c == chunk], check=True)
                    held.setdefault(chunk, []).append(tokens)
                    size += len(tokens.word)
                if size >= 2 * COUNT_TOKENS:
                    yield from pack()
                    size = 0
        yield from pack()

    # the whole of `dealt`, so that both sides read the same exchange
    words = bound_batches(dealt).mapInArrow(words_of, "chunk long, word long, check int")
    known = words.join(counts, ["word", "check"]).select("chunk", "word", "n").distinct()

    def score(texts: pa.Table, words: pa.Table) -> pa.Table:
        known_words, known_counts = words.column("word").to_numpy().view(np.uint64), words.column("n").to_numpy()
        order = np.argsort(known_words)
        known_words, known_counts = np.append(known_words[order], np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(known_counts[order], 0)
        sizes_, known_, base_, score_ = [], [], [], []
        for tokens in _batches(_strings(texts.select(["text"]).to_batches())):
            at = np.searchsorted(known_words, tokens.word)
            c = np.where(known_words[at] == tokens.word, known_counts[at], 0)
            doc = np.repeat(np.arange(len(tokens.sizes)), tokens.sizes)
            share = np.log10(c + 0.5)
            sizes_.append(tokens.sizes)
            known_.append(np.bincount(doc, weights=c > 0))
            base_.append(np.bincount(doc, weights=share - base_norm))
            score_.append(np.bincount(doc, weights=share - cell_norm[tokens.classes * GROUPS + tokens.groups] + model.log10(Batch(tokens))))
        columns = [np.concatenate(x) if x else np.zeros(0) for x in (sizes_, known_, base_, score_)]
        n = len(columns[0])
        arrays = [texts.column("doc_id"), columns[0].astype(np.int64), columns[1].astype(np.int64), np.full(n, total, np.int64), columns[2], columns[3]]
        return pa.table(arrays, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, schema)

"""Main-text extraction by a recurrent block labeller.

Method: a page is a sequence of leaf blocks.  Each block is read as a vector of its tag path and of
its hashed words, with its length, link share and place.  A bidirectional LSTM (numpy) runs over
the whole sequence, so every block is judged in the context of the page, and gives the probability
that it is main text.  Blocks of main text are joined in page order.

Training: no table says which blocks are main text, so the labels come from pages whose mark-up
says so (``article`` or ``main``, less what navigation, asides, forms and named boilerplate hold),
and from layouts made of the same pages' texts in many other mark-ups.  The sample is bounded:
``SAMPLE_PAGES`` pages by a hash of their id, none over ``SAMPLE_CHARS``.  One task trains; the
weights have a fixed size.

Scale: extraction is a narrow map over whole pages, no shuffle.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import map_rows, ship_by_value
from stratus.llm.html_blocks import blocks_of

ship_by_value(__name__)

SAMPLE_PAGES = 300
SAMPLE_CHARS = 60_000
PATH_DIMS, WORD_DIMS, PLAIN_DIMS = 96, 32, 10
INPUTS = PATH_DIMS + WORD_DIMS + PLAIN_DIMS
HIDDEN = 24
EPOCHS = 10
TRAIN_BLOCKS = 100
TRAIN_BATCH = 32
RATE = 0.01
SEED = 11

#: fixed values: names of page parts that are not main text, of those that hold it, and neutral ones
PARTS = {
    "menu": "nav navbar navigation menu topnav menubar breadcrumb breadcrumbs toc pagination skip".split(),
    "header": "header masthead banner topbar branding".split(),
    "aside": "sidebar aside widget related recommended popular trending rail teaser tags".split(),
    "advert": "ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message disclaimer paywall".split(),
    "form": "form newsletter subscribe search login signup contact feedback poll".split(),
    "comments": "comments comment replies reply responses discussion disqus respond".split(),
    "footer": "footer colophon copyright legal bottom credits".split(),
    "share": "share social sharing follow author-bio byline meta".split(),
}
CONTENT = "content article post entry story body text main page blog news article-body post-content entry-content main-content story-body".split()
NEUTRAL = "container wrapper row col inner page site layout grid box section block clearfix outer wrap column".split()
BOILERPLATE_TAGS = frozenset("nav aside footer form select button fieldset dialog menu".split())
BOILERPLATE_NAMES = frozenset("." + n for names in PARTS.values() for n in names if n not in ("header", "meta", "page", "message", "text"))
SHORT = "Home;About us;Contact;Privacy policy;Terms of use;Subscribe;Log in;Sign up;Search;Share;Tweet;Read more;Next;Previous;Back to top;All rights reserved;Reply;Like;Menu;Skip to content;Advertisement;Sponsored;Related;Tags;Comments;Leave a comment;Accept all;Cookie settings;Newsletter;Email;Name;Send".split(";")


def bucket(text: str, dims: int, salt: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"), salt) % dims


class Reader:
    """Blocks -> input vectors; keeps what it knows of paths and words."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path_vector(self, path: tuple[str, ...]) -> np.ndarray:
        """Signed hashes: the innermost element counts most, and each entry once more with its distance."""
        found = self.paths.get(path)
        if found is None:
            found = np.zeros(PATH_DIMS, np.float32)
            for distance, entry in enumerate(reversed(path)):
                sign = 1 if bucket(entry, 2, 5) else -1
                found[bucket(entry, PATH_DIMS, 1)] += sign
                if distance < 2:
                    found[bucket(f"{distance}{entry}", PATH_DIMS, 2)] += sign
            np.clip(found, -2, 2, out=found)
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = found
        return found

    def word_bucket(self, word: str) -> int:
        if len(self.words) > 200_000:
            self.words.clear()
        self.words[word] = found = bucket(word, WORD_DIMS, 3)
        return found

    def vectors(self, blocks: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
        out = np.zeros((len(blocks), INPUTS), np.float32)
        total = sum(len(t) for _, t, _ in blocks) or 1
        before = 0
        known, look_up = self.words, self.word_bucket
        for i, (path, text, linked) in enumerate(blocks):
            out[i, :PATH_DIMS] = self.path_vector(path)
            words = text.lower().split()
            counts = np.bincount([known[w] if w in known else look_up(w) for w in words], minlength=WORD_DIMS)
            out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.sqrt(counts @ counts)
            n = len(text)
            out[i, PATH_DIMS + WORD_DIMS :] = (
                np.log1p(n) / 5,
                np.log1p(len(words)) / 4,
                linked / n,
                before / total,
                i / len(blocks),
                n / total,
                text[-1] in ".!?…\"”»",
                sum(text.count(c) for c in ".,;") / len(words) if len(words) < 200 else 0.15,
                any(c in text for c in "©|»›•"),
                len(path) / 10,
            )
            before += n
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    weights = {}
    for way in ("f", "b"):
        weights[f"wx{way}"] = rng.normal(0, INPUTS**-0.5, (INPUTS, 4 * HIDDEN))
        weights[f"wh{way}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        weights[f"b{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # the forget gate begins open
    weights["wo"] = rng.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN)
    weights["wd"] = np.zeros(INPUTS)
    weights["bo"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in weights.items()}


def lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = False):
    """States ``(time, page, HIDDEN)`` for inputs ``(time, page, INPUTS)``; padding leaves a state as it is."""
    steps, pages = mask.shape
    given = x @ wx + b
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    states, kept = np.empty((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        z = given[t] + h @ wh
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        new_c = f * c + i * g
        tanh_c = np.tanh(new_c)
        m = mask[t][:, None]
        if keep:
            kept.append((h, c, i, f, o, g, tanh_c))
        h, c = m * (o * tanh_c) + (1 - m) * h, m * new_c + (1 - m) * c
        states[t] = h
    return states, kept


def lstm_back(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list, upper: np.ndarray):
    """Gradients of ``wx``, ``wh`` and ``b`` for the states' gradients ``upper``."""
    steps = len(kept)
    dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros_like(upper[0]), np.zeros_like(upper[0])
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tanh_c = kept[t]
        m = mask[t][:, None]
        dh = dh + upper[t]
        dh_in, dc_in = m * dh, m * dc
        dc_in = dc_in + dh_in * o * (1 - tanh_c**2)
        dz = np.concatenate([dc_in * g * i * (1 - i), dc_in * c * f * (1 - f), dh_in * tanh_c * o * (1 - o), dc_in * i * (1 - g**2)], axis=1)
        dz_all[t] = dz
        dwh += h.T @ dz
        dh, dc = dz @ wh.T + (1 - m) * dh, dc_in * f + (1 - m) * dc
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, sequences))
    x = np.zeros((longest, len(sequences), INPUTS), np.float32)
    mask = np.zeros((longest, len(sequences)), np.float32)
    for k, s in enumerate(sequences):
        x[: len(s), k], mask[: len(s), k] = s, 1
    return x, mask


def reversed_in_mask(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each page's own steps from last to first; padding stays behind them."""
    lengths = mask.sum(axis=0).astype(np.int64)
    at = lengths[None, :] - 1 - np.arange(len(mask))[:, None]
    at = np.where(at >= 0, at, np.arange(len(mask))[:, None])
    return np.take_along_axis(x, at[:, :, None], axis=0)


def logits(weights: dict[str, np.ndarray], sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Score of each block of each page (above zero: main text)."""
    x, mask = padded(sequences)
    forth, _ = lstm(x, mask, weights["wxf"], weights["whf"], weights["bf"])
    back, _ = lstm(reversed_in_mask(x, mask), mask, weights["wxb"], weights["whb"], weights["bb"])
    score = np.concatenate([forth, reversed_in_mask(back, mask)], axis=2) @ weights["wo"] + x @ weights["wd"] + weights["bo"]
    return [score[: len(s), k] for k, s in enumerate(sequences)]


def fit(examples: list[tuple[np.ndarray, np.ndarray]], seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights for ``(vectors, labels)`` of pages: logistic loss, Adam, ``EPOCHS`` passes."""
    rng = np.random.default_rng(seed)
    weights = new_weights(rng)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    done, total = 0, EPOCHS * -(-len(examples) // TRAIN_BATCH)
    for _ in range(EPOCHS):
        order = sorted(rng.permutation(len(examples)).tolist(), key=lambda k: len(examples[k][0]) // 8)
        batches = [order[a : a + TRAIN_BATCH] for a in range(0, len(order), TRAIN_BATCH)]
        for number in rng.permutation(len(batches)):
            chosen = [examples[k] for k in batches[number]]
            x, mask = padded([v for v, _ in chosen])
            y = np.zeros_like(mask)
            for k, (_, labels) in enumerate(chosen):
                y[: len(labels), k] = labels
            x = x * (rng.random((1, len(chosen), x.shape[2])) > 0.1)  # no input is relied on alone
            rx = reversed_in_mask(x, mask)
            forth, kept_f = lstm(x, mask, weights["wxf"], weights["whf"], weights["bf"], True)
            back, kept_b = lstm(rx, mask, weights["wxb"], weights["whb"], weights["bb"], True)
            both = np.concatenate([forth, reversed_in_mask(back, mask)], axis=2)
            error = mask * (sigmoid(both @ weights["wo"] + x @ weights["wd"] + weights["bo"]) - y) / mask.sum()
            gradient = {"wo": np.einsum("tp,tph->h", error, both), "wd": np.einsum("tp,tpi->i", error, x), "bo": error.sum(keepdims=True).ravel()}
            upper = error[:, :, None] * weights["wo"]
            gradient["wxf"], gradient["whf"], gradient["bf"] = lstm_back(x, mask, weights["wxf"], weights["whf"], kept_f, upper[:, :, :HIDDEN])
            gradient["wxb"], gradient["whb"], gradient["bb"] = lstm_back(
                rx, mask, weights["wxb"], weights["whb"], kept_b, reversed_in_mask(upper[:, :, HIDDEN:], mask)
            )
            norm = np.sqrt(sum(float((g**2).sum()) for g in gradient.values()))
            done += 1
            rate = RATE * (1 - 0.9 * done / total)
            for k, g in gradient.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                weights[k] -= (rate * first[k] / (1 - 0.9**done) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
    return weights


def marked_label(path: tuple[str, ...]) -> bool:
    """Whether the mark-up itself says that a block is main text."""
    inside = max((i for i, x in enumerate(path) if x in ("article", "main")), default=-1)
    if inside < 0:
        return False
    return not any(x in BOILERPLATE_TAGS or x in BOILERPLATE_NAMES for x in path)


class Layouts:
    """Pages in many mark-ups from a pool of texts; main text begins with ``MARK``."""

    MARK = "\ue000"  # a private-use character

    def __init__(self, long: list[str], short: list[str], rng: np.random.Generator):
        self.long, self.short, self.rng = long, short, rng

    def pick(self, values):
        return values[int(self.rng.integers(len(values)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def text(self, long: bool) -> str:
        text = self.pick(self.long if long and self.long else self.short)
        return text.replace("&", "&amp;").replace("<", "&lt;")

    def wrap(self, inner: str, tags: list[str], names: list[str]) -> str:
        tag = self.pick(tags)
        name = self.pick(names)
        named = "" if tag not in ("div", "section", "ul") and self.chance(0.6) else f' {self.pick(["class", "class", "id"])}="{name}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.text(False)}</a>' for i in range(n)]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if self.chance(0.7) else " ".join(items)

    def words(self, mark: str = "") -> str:
        """A paragraph, of any length, closed or not."""
        body = mark + self.text(self.chance(0.8))
        if self.chance(0.15):
            body = f"<b>{body}"
        if self.chance(0.2):
            body += f' <a href="#">{self.pick(SHORT)}</a>' if not mark else f" <em>{self.text(False)}</em>"
        return f"<p>{body}" + ("</p>" if self.chance(0.9) else "<br>")

    def part(self, kind: str) -> str:
        names = PARTS[kind]
        some = int(self.rng.integers(1, 5))
        if kind == "menu":
            return self.wrap(self.links(some + 2), ["nav", "nav", "div", "ul"], names)
        if kind == "header":
            title = f"<h1>{self.text(False)}</h1>" if self.chance(0.4) else f"<div>{self.text(False)}</div>"
            return self.wrap(title + (self.words() if self.chance(0.4) else "") + (self.part("menu") if self.chance(0.4) else ""), ["header", "header", "div"], names)
        if kind == "form":
            fields = f"<label>{self.pick(SHORT)}</label><input><button>{self.pick(SHORT)}</button>"
            return self.wrap((self.words() if self.chance(0.6) else "") + fields, ["form", "form", "div", "section"], names)
        if kind == "comments":
            each = [self.wrap(f"<b>{self.text(False)}</b>" + "".join(self.words() for _ in range(int(self.rng.integers(1, 3)))), ["div", "li", "article"], ["comment", "reply", "comment-body"]) for _ in range(some)]
            return self.wrap((f"<h3>{self.pick(SHORT)}</h3>" if self.chance(0.6) else "") + "".join(each), ["div", "section", "div"], names)
        if kind == "footer":
            return self.wrap("&copy; " + self.text(False) + " &middot; " + self.text(self.chance(0.5)) + (self.links(some) if self.chance(0.5) else ""), ["footer", "footer", "div"], names)
        if kind == "aside":
            body = f"<h3>{self.text(False)}</h3>" + (self.links(some) if self.chance(0.6) else "".join(self.words() for _ in range(some)))
            return self.wrap(body, ["aside", "aside", "div", "section"], names)
        body = self.text(self.chance(0.6)) if self.chance(0.5) else "".join(self.words() for _ in range(min(2, some)))
        return self.wrap(body, ["div", "div", "section", "p"] if not body.startswith("<p") else ["div", "section"], names)

    def page(self) -> str:
        mark = self.MARK
        inner = f"<h1>{mark}{self.text(False)}</h1>" if self.chance(0.8) else ""
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.8:
                inner += self.words(mark)
            elif kind < 0.85:
                inner += f"<h2>{mark}{self.text(False)}</h2>"
            elif kind < 0.9:
                inner += "<ul>" + "".join(f"<li>{mark}{self.text(self.chance(0.5))}</li>" for _ in range(3)) + "</ul>"
            elif kind < 0.93:
                inner += f"<blockquote>{self.words(mark)}</blockquote>"
            elif kind < 0.95:
                inner += f"<table><tr><td>{mark}{self.text(False)}</td><td>{mark}{self.text(False)}</td></tr></table>"
            else:
                inner += self.part(self.pick(["advert", "share", "notice", "form", "aside"]))
        inner = self.wrap(inner, ["article", "article", "main", "div", "div", "section"], CONTENT)
        before = [self.part(k) for k in ("menu", "header", "notice", "advert", "aside", "form", "share") if self.chance(0.35)]
        after = [self.part(k) for k in ("comments", "aside", "advert", "share", "form", "menu", "notice", "footer") if self.chance(0.4)]
        body = "".join([before[i] for i in self.rng.permutation(len(before))] + [inner] + after)
        for _ in range(int(self.rng.integers(0, 3))):
            body = self.wrap(body, ["div"], NEUTRAL)
        return f"<html><head><title>x</title></head><body>{body}</body></html>"


def examples_of(pages: list[str], seed: int = SEED, layouts_per_page: int = 10) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences: the pages whose mark-up tells main text, and layouts made of all pages' texts."""
    rng, reader = np.random.default_rng(seed), Reader()
    parsed = [blocks_of(p) for p in pages]
    found = []
    for blocks in parsed:
        labels = np.array([marked_label(path) for path, _, _ in blocks], np.float32)
        if labels.any():
            found.append((blocks, labels))
    texts = list(dict.fromkeys(t for blocks in parsed for _, t, _ in blocks))
    long, short = [t for t in texts if len(t.split()) >= 8], [t for t in texts if len(t.split()) < 8] + SHORT
    layouts = Layouts(long, short, rng)
    for _ in range(layouts_per_page * len(pages)):
        blocks = blocks_of(layouts.page())
        labels = np.array([t.startswith(Layouts.MARK) for _, t, _ in blocks], np.float32)
        found.append(([(p, t.removeprefix(Layouts.MARK) or "x", a) for p, t, a in blocks], labels))
    return [(reader.vectors(b)[:TRAIN_BLOCKS], y[:TRAIN_BLOCKS]) for b, y in found if b]


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> dict[str, np.ndarray]:
    """Weights from about ``sample_pages`` pages, drawn by a hash of id and page.  No pages: untrained weights."""
    rows = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(id_col, html_col).alias("draw"), F.col(html_col).cast("string").alias("html"))
    rows = rows.where(F.length("html") <= SAMPLE_CHARS).orderBy("draw").limit(sample_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = sorted({(d, h) for b in batches for d, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)})
        if drawn:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(examples_of([h for _, h in drawn])))], pa.binary())], names=["weights"])

    trained = rows.repartition(1).mapInArrow(run, "weights binary").first()  # a bounded sample
    return pickle.loads(trained[0]) if trained else new_weights(np.random.default_rng(SEED))


def main_text(weights: dict[str, np.ndarray], reader: Reader, htmls: list[str | None]) -> list[str]:
    """Main text of each page ("" if none): pages of similar length share a batch."""
    parsed = [blocks_of(h) for h in htmls]
    out = [""] * len(htmls)
    order = sorted((k for k, b in enumerate(parsed) if b), key=lambda k: len(parsed[k]))
    while order:
        longest = len(parsed[order[-1]])
        batch = [k for k in order if len(parsed[k]) >= longest // 2]
        order = order[: len(order) - len(batch)]
        for k, score in zip(batch, logits(weights, [reader.vectors(parsed[k]) for k in batch]), strict=True):
            out[k] = " ".join(text for (_, text, _), s in zip(parsed[k], score, strict=True) if s > 0)
    return out


def extract(
    pages: DataFrame, weights: dict[str, np.ndarray] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row, repeated rows included.

    Without ``weights`` they are trained on ``pages``.  A null or empty page, and one without main
    text, has the empty text.  Other columns are not looked at.  No rows give no rows.
    """
    weights = train(pages, id_col, html_col) if weights is None else weights

    def make():
        reader = Reader()

        def fn(columns):
            texts = main_text(weights, reader, columns[2])
            return [columns[0], columns[1], texts, [len(t) for t in texts]]

        return fn

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_rows(rows, make, "page_id long, url string, text string, n_chars long", slice_rows=64)

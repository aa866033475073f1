"""Main text of HTML pages by a recurrent block labeller (operator 10).

A page is a sequence of leaf blocks (``html_blocks``).  Each block is a vector of its hashed path of enclosing
elements (tags and the words of their classes, ids and roles), its hashed words and a few measures; a
bidirectional LSTM in numpy reads the sequence from both ends and classifies every block with the whole page
as context.  The kept blocks, in page order, are the text.

The labeller is trained here, on a bounded sample of ``SAMPLE`` distinct pages (those of smallest hash): semantic
elements give the labels (inside ``article`` or ``main``, not in navigation, forms and the like), and every
page is also shown in variants in which these elements are replaced by the generic containers that other
sites use and in which menus, notices, sidebars, forms, adverts and reader comments are added from the page's
own words, so that the labeller learns from names, wording and place rather than one template.

Training runs once on the driver over that bounded sample; labelling is one scan without a shuffle.  Defined
results: null, empty and textless pages give an empty text; repeated rows, null ids and null urls give a row
each; broken or unclosed markup ends where the page ends; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .html_blocks import Block, blocks

#: Bounds of the fit: pages of the sample and blocks of a page that is trained on.
SAMPLE, MOST_BLOCKS = 240, 120
VARIANTS, EPOCHS, HIDDEN = 4, 24, 16
PATH, LEAF, WORDS, MEASURES = 96, 16, 32, 8
WIDTH = PATH + LEAF + WORDS + MEASURES
#: Padded steps that are labelled at once.
STEPS = 20_000

TEACH_IN = {"article", "main"}
TEACH_OUT = {"nav", "aside", "footer", "form"}
NAMES = {
    "text": ["article", "main", "div content", "div post", "div entry content", "div article body", "section story",
             "div main", "div text", "div post body", "section", "div", "td", "div page content", "div article"],
    "menu": ["nav", "div menu", "ul navbar", "div navigation", "div nav", "ul menu", "div breadcrumb", "div links"],
    "header": ["header", "div header", "div masthead", "div top", "header site header", "div banner"],
    "footer": ["footer", "div footer", "div copyright", "div bottom", "footer site footer", "div legal"],
    "advert": ["div ad", "div advert", "aside sponsored", "div ads", "div promo", "div advertisement", "div sponsor"],
    "sidebar": ["aside", "div sidebar", "div related", "div widget", "aside sidebar", "div recommended", "div trending"],
    "notice": ["div cookie", "div notice", "div consent banner", "div alert", "section gdpr", "div popup", "div cookie notice"],
    "form": ["form", "div newsletter", "form search", "div subscribe", "form login", "div signup"],
    "comments": ["section comments", "div comments", "div comment list", "ol commentlist", "div disqus thread",
                 "section reader comments", "div responses", "div comment"],
    "share": ["div share", "ul social", "div social share", "div tags"],
}
WRAPPERS = ["div wrapper", "div container", "div page", "div site", "div row", "section", "div inner", "div"]
TEXT_LEAVES = ["p"] * 8 + ["li", "blockquote", "h2", "h3", "td", "dd", "pre", "div"]

_PLACE: dict[tuple[str, int], int] = {}


def _place(word: str, width: int) -> int:
    key = (word, width)
    if key not in _PLACE:
        if len(_PLACE) > 500_000:
            _PLACE.clear()
        _PLACE[key] = zlib.crc32(word.encode("utf-8")) % width
    return _PLACE[key]


def vectors(page: list[Block]) -> np.ndarray:
    """One row of ``WIDTH`` numbers per block."""
    out = np.zeros((len(page), WIDTH), np.float32)
    for i, b in enumerate(page):
        row = out[i]
        for tag, names in b.path:
            row[_place(tag, PATH)] = 1.0
            for n in names:
                row[_place("." + n, PATH)] = 1.0
        row[PATH + _place(b.path[-1][0] if b.path else "", LEAF)] = 1.0
        words = b.text.split(" ")
        held = np.bincount([_place(w, WORDS) for w in words], minlength=WORDS)
        row[PATH + LEAF:PATH + LEAF + WORDS] = np.sqrt(held / len(words))
        size = len(b.text)
        row[PATH + LEAF + WORDS:] = (
            np.log1p(len(words)) / 5, min(b.link_chars / size, 1.0), min(size / len(words) / 10, 2.0),
            sum(map(b.text.count, ".,;:!?")) / len(words), i / len(page), np.log1p(len(page)) / 5,
            float(b.text[-1] in ".!?:\"'"), min(len(words), 20) / 20)
    return out


def teacher(page: list[Block]) -> list[int]:
    """1 for blocks that semantic elements mark as the article; without such elements, for long linkless blocks."""
    marked = any(tag in TEACH_IN or "main" in names and tag != "div" for b in page for tag, names in b.path)
    if not marked:
        return [int(len(b.text.split()) >= 25 and b.link_chars < 0.3 * len(b.text)) for b in page]
    return [int(any(t in TEACH_IN for t, _ in b.path) and not any(t in TEACH_OUT for t, _ in b.path)
                and not any(n.startswith("comment") for _, names in b.path for n in names)) for b in page]


def _element(spec: str):
    tag, *names = spec.split()
    return tag, tuple(names)


def variant(page: list[Block], labels: list[int], rng: random.Random) -> tuple[list[Block], list[int]]:
    """The page as another site might have built it."""
    words = [w for b in page for w in b.text.split()[:60]] or ["text"]
    outer = tuple(_element(rng.choice(WRAPPERS)) for _ in range(rng.randint(0, 2)))

    def some(least: int, most: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(least, most)))

    def made(kind: str, n: int, least: int, most: int, leaves: list[str], links: float, inside=()):
        holder = tuple(outer) + tuple(inside) + (_element(rng.choice(NAMES[kind])),)
        got = []
        for _ in range(n):
            text = some(least, most)
            got.append((Block(text, holder + (_element(rng.choice(leaves)),), len(text) if rng.random() < links else 0), 0))
        return got

    holder = tuple(outer) + tuple(_element(rng.choice(WRAPPERS)) for _ in range(rng.randint(0, 1))) \
        + (_element(rng.choice(NAMES["text"])),)
    article = []
    for b, y in zip(page, labels):
        if y:
            leaf = b.path[-1][0] if b.path and b.path[-1][0] in ("h1", "h2", "h3", "p") else "p"
            leaf = rng.choice(TEXT_LEAVES) if leaf == "p" else leaf
            text = b.text if rng.random() < 0.8 else some(3, 60)
            around = ((rng.choice(["ul", "ol"]), ()),) if leaf == "li" else ()
            article.append((Block(text, holder + around + ((leaf, ()),), b.link_chars), 1))
            if rng.random() < 0.12:
                listed = holder + ((rng.choice(["ul", "ol"]), ()), ("li", ()))
                for _ in range(rng.randint(2, 6)):
                    item = some(2, 18)
                    article.append((Block(item, listed, len(item) if rng.random() < 0.1 else 0), 1))
            if rng.random() < 0.04:
                article += made("advert", 1, 3, 25, ["p", "div"], 0.4, holder[len(outer):])
    kinds: dict[str, list] = {}
    for b, y in zip(page, labels):
        if not y:
            tags = {t for t, _ in b.path}
            kind = "menu" if "nav" in tags else "footer" if "footer" in tags else "advert"
            kinds.setdefault(kind, []).append(b)
    renamed = {k: tuple(outer) + (_element(rng.choice(NAMES[k])),) for k in ("menu", "footer", "advert")}
    old = {k: [(Block(b.text, renamed[k] + (b.path[-1:] if b.path and b.path[-1][0] in ("li", "p") else ()),
                      b.link_chars), 0) for b in got] for k, got in kinds.items()}
    before, after = [], []
    if rng.random() < 0.6:
        before += made("header", rng.randint(1, 3), 1, 8, ["h1", "p", "div", "a"], 0.5)
    before += old.get("menu", []) if rng.random() < 0.9 else []
    if rng.random() < 0.4:
        (before if rng.random() < 0.5 else after).extend(made("notice", rng.randint(1, 2), 8, 40, ["p", "div", "span"], 0.1))
    (before if rng.random() < 0.6 else after).extend(old.get("advert", []))
    if rng.random() < 0.5:
        (before if rng.random() < 0.4 else after).extend(made("sidebar", rng.randint(2, 8), 2, 25, ["li", "p", "h3"], 0.6))
    if rng.random() < 0.4:
        (before if rng.random() < 0.3 else after).extend(made("form", rng.randint(1, 3), 1, 12, ["p", "div", "h3"], 0.0))
    tail = made("share", rng.randint(1, 4), 1, 3, ["li", "div"], 0.7) if rng.random() < 0.3 else []
    if rng.random() < 0.6:
        inside = holder[len(outer):] if rng.random() < 0.4 else ()
        tail += made("comments", rng.randint(1, 8), 3, 70, ["p", "li", "div", "h3", "p"], 0.05, inside)
    after = tail + after + old.get("footer", [])
    if rng.random() < 0.3:
        after += made("footer", rng.randint(1, 3), 3, 20, ["p", "div", "li"], 0.4)
    both = before + article + after
    return [b for b, _ in both], [y for _, y in both]


class Labeller:
    """A bidirectional LSTM with a logistic output per step."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in ("f", "b"):
            self.p["W" + d] = (rng.standard_normal((WIDTH, 4 * h)) * 0.15).astype(np.float32)
            self.p["U" + d] = (rng.standard_normal((h, 4 * h)) * 0.2).astype(np.float32)
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.p["o"] = (rng.standard_normal(2 * h) * 0.3).astype(np.float32)
        self.p["k"] = np.zeros(1, np.float32)

    @staticmethod
    def _flip(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each sequence in ``x`` (batch, steps, ...) turned round within its own length."""
        steps = np.arange(x.shape[1])
        at = np.where(steps < sizes[:, None], sizes[:, None] - 1 - steps, steps)
        return x[np.arange(len(x))[:, None], at]

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction; with ``keep``, what the way back needs."""
        p, h = self.p, HIDDEN
        gates = x @ p["W" + d] + p["c" + d]
        n, steps, _ = x.shape
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, tape = np.empty((n, steps, h), np.float32), []
        for t in range(steps):
            g = gates[:, t] + state @ p["U" + d]
            s = 1 / (1 + np.exp(-np.clip(g[:, :3 * h], -30, 30)))
            i, f, o = s[:, :h], s[:, h:2 * h], s[:, 2 * h:]
            c = np.tanh(g[:, 3 * h:])
            last, cell = cell, f * cell + i * c
            th = np.tanh(cell)
            if keep:
                tape.append((i, f, o, c, last, th, state))
            state = o * th
            out[:, t] = state
        return out, tape

    def scores(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Probability per step of each padded sequence."""
        ahead, tf = self._run(x, "f", keep)
        turned = self._flip(x, sizes)
        back, tb = self._run(turned, "b", keep)
        both = np.concatenate([ahead, self._flip(back, sizes)], axis=2)
        y = 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["k"], -30, 30)))
        return (y, both, turned, tf, tb) if keep else y

    def _back(self, x, grad, tape, d: str, grads: dict) -> None:
        p, h = self.p, HIDDEN
        n, steps, _ = x.shape
        dgates = np.empty((n, steps, 4 * h), np.float32)
        dstate, dcell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        u = np.zeros_like(p["U" + d])
        for t in range(steps - 1, -1, -1):
            i, f, o, c, last, th, state = tape[t]
            dh = grad[:, t] + dstate
            dc = dcell + dh * o * (1 - th * th)
            g = np.concatenate([dc * c * i * (1 - i), dc * last * f * (1 - f), dh * th * o * (1 - o),
                                dc * i * (1 - c * c)], axis=1)
            dgates[:, t] = g
            dstate, dcell = g @ p["U" + d].T, dc * f
            u += state.T @ g
        flat = dgates.reshape(-1, 4 * h)
        grads["U" + d], grads["c" + d] = u, flat.sum(0)
        grads["W" + d] = x.reshape(-1, WIDTH).T @ flat

    def fit(self, data: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> "Labeller":
        """Cross-entropy by Adam, over batches of sequences of like length."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        order = sorted(range(len(data)), key=lambda i: len(data[i][1]))
        batches = [order[i:i + 32] for i in range(0, len(order), 32)]
        step = 0
        for epoch in range(epochs):
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            for b in rng.permutation(len(batches)):
                x, y, sizes = padded([data[i] for i in batches[b]])
                got, both, turned, tf, tb = self.scores(x, sizes, keep=True)
                mask = np.arange(x.shape[1]) < sizes[:, None]
                d = ((got - y) * mask / mask.sum()).astype(np.float32)
                grads = {"o": np.einsum("nt,nth->h", d, both), "k": d.sum(keepdims=True).reshape(1)}
                dh = d[:, :, None] * self.p["o"]
                self._back(x, dh[:, :, :HIDDEN], tf, "f", grads)
                self._back(turned, self._flip(dh[:, :, HIDDEN:], sizes), tb, "b", grads)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1) + 1e-5 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the probability of each block; pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
        while order:
            batch = [order.pop()]
            longest = len(pages[batch[0]])
            while order and (len(batch) + 1) * longest <= STEPS and len(batch) < 256:
                batch.append(order.pop())
            x, _, sizes = padded([(vectors(pages[i]), None) for i in batch])
            y = self.scores(x, sizes)
            for row, i in enumerate(batch):
                out[i] = y[row, :sizes[row]]
        return out


def padded(data):
    sizes = np.array([len(x) for x, _ in data])
    x = np.zeros((len(data), sizes.max(), WIDTH), np.float32)
    y = np.zeros((len(data), sizes.max()), np.float32)
    for i, (v, t) in enumerate(data):
        x[i, :len(v)] = v
        if t is not None:
            y[i, :len(v)] = t
    return x, y, sizes


def training_set(pages: list[str], variants: int = VARIANTS, seed: int = 7):
    """(vectors, labels) of the sample pages and their variants."""
    rng = random.Random(seed)
    out = []
    for page in pages:
        found = blocks(page)
        if not found:
            continue
        if len(found) > MOST_BLOCKS:            # any window of a long page, not its beginning
            at = rng.randrange(len(found) - MOST_BLOCKS + 1)
            found = found[at:at + MOST_BLOCKS]
        labels = teacher(found)
        out.append((vectors(found), np.array(labels, np.float32)))
        for _ in range(variants if any(labels) else 0):
            made, of = variant(found, labels, rng)
            out.append((vectors(made), np.array(of, np.float32)))
    return out


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """A labeller fitted on the ``sample`` distinct pages of smallest hash."""
    hashed = (pages.select(F.col(html_col).alias("html")).where(F.length("html") > 0)
              .select("html", F.xxhash64("html").alias("h")))
    # the hashes alone are sorted: with the pages, every task would send a whole sample to the driver
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    chosen = hashed.where(F.col("h").isin(least)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h")
    data = training_set([r["html"] for r in chosen.collect()]) if least else []
    model = Labeller()
    return model.fit(data) if data else model


def _extract(model: Labeller):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, counts, kept = [], [], []
            column = batch.column("html").to_pylist()
            for at in range(0, len(column), 512):
                pages = [blocks(h) if h else [] for h in column[at:at + 512]]
                for page, y in zip(pages, model.label(pages)):
                    good = [b.text for b, s in zip(page, y) if s >= 0.5]
                    texts.append("\n\n".join(good))
                    counts.append(len(page))
                    kept.append(len(good))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int32()), pa.array(kept, pa.int32())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])
    return run


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept for every row of ``pages``."""
    ship_package(pages.sparkSession)
    model = model or train(pages, html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long, n_blocks int, n_kept int")

"""Toxicity by the nearest labelled examples (operator 3).

Texts are vectors over all words of a bounded sample of labelled texts: TF-IDF, times one plus the root of the
word's chi-square against the label, so that words which mark a label weigh more and no word is left out.  The
chi-square is taken over distinct contexts (the words around a word where a text has it first), so that copies
of one text speak once; document frequencies count every document.  A word that no example has counts as its
longest beginning of 4 to 6 letters that one has; failing that it adds to the text's length alone, with the
weight of a word in no document.  A text is scored by its ``NEIGHBOURS`` nearest examples by exact cosine, summed
over an inverted index of the examples; words that stand in many of them are kept as full rows, which a matrix
product adds for a batch of texts at once.  The neighbours vote with weights ``cosine ** 2 / (SOFT + distance)``,
corrected for the sampling rate of their label, beside a small vote for the share of toxic rows (so remote
neighbours decide little); a logistic curve fitted on leave-one-out votes of the examples turns the vote into a
probability.  Texts that share no word with an example get the (smoothed) share of toxic texts among examples
without words.

The fit reads at most ``EXAMPLES`` labelled rows of each label, those of smallest hash of the id; that bound
makes the index small enough to travel with the task.  Everything else covers all documents: scoring is one
scan that never shuffles text.

Defined results: null and empty texts have no terms; rows with a null id or label teach nothing; an id with
several labels counts as toxic if one says so; repeated rows are scored each time; ties among neighbours go
to the smaller example id; with no usable label every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import give_back, materialize, ship_package, sliced
from .common import released

#: Bound of the fit: labelled rows of each label.
EXAMPLES = 4_000
#: A word that at least one in ``BLOCK`` examples has is kept as a full row; ``BATCH`` texts are scored at once.
NEIGHBOURS, BLOCK, BATCH = 15, 16, 64
SOFT, PRIOR = 0.05, 0.02
BEGINNINGS = (6, 5, 4)
#: Rows that are judged, and given back to Spark, at a time.
ROWS = 500

_WORD = re.compile(r"\w+")


def first_contexts(text: str) -> dict[str, int]:
    """Every word with the hash of its first context."""
    words = _WORD.findall(text.lower())
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        if w not in out:
            out[w] = zlib.crc32(" ".join(words[max(i - 1, 0):i + 2]).encode())
    return out


#: Words without a number of their own that a task remembers.
REMEMBERED = 200_000


class _Numbers(dict):
    """Word -> number; other words count as their longest beginning that has one, or as -1, and are remembered."""

    def __init__(self, known):
        super().__init__(known)
        self.others: dict[str, int] = {}

    def __missing__(self, w: str) -> int:
        i = self.others.get(w)
        if i is None:
            i = next((self[w[:k]] for k in BEGINNINGS if len(w) > k and w[:k] in self), -1)
            if len(self.others) < REMEMBERED:
                self.others[w] = i
        return i


class Terms:
    """Numbers the words of the examples and counts them in a text.

    The words are held as one string; the dictionary over them exists only while texts are read.
    """

    def __init__(self, vocabulary):
        self.size, self.joined = len(vocabulary), "\n".join(vocabulary)
        self.number: _Numbers | None = None

    def __getstate__(self):
        return self.__dict__ | {"number": None}

    def counts(self, text: str | None) -> tuple[dict[int, int], list[int]]:
        """word number -> how often it occurs, and the counts of the words that no example has"""
        if not self.size or not text:
            return {}, []
        number, out, strange = self._numbers(), {}, []
        for w, n in Counter(_WORD.findall(text.lower())).items():
            i = number[w]
            if i < 0:
                strange.append(n)
            else:
                out[i] = out.get(i, 0) + n
        return out, strange

    def distinct(self, text: str | None) -> set[int]:
        """The numbers of the words in ``text``."""
        if not self.size or not text:
            return set()
        found = set(map(self._numbers().__getitem__, set(_WORD.findall(text.lower()))))
        found.discard(-1)
        return found

    def _numbers(self) -> "_Numbers":
        if self.number is None:
            self.number = _Numbers(zip(self.joined.split("\n"), range(self.size)))
        return self.number


def _arrays(vector):
    """A vector as ascending term numbers and their weights."""
    import numpy as np

    if not isinstance(vector, dict):
        return vector
    terms = sorted(vector)
    return np.array(terms, np.int64), np.array([vector[t] for t in terms], float)


class Examples:
    """Inverted index over the labelled examples' vectors; terms of many examples are full rows.

    The full rows are held as their entries and laid out only while texts are judged.
    """

    def __init__(self, ids, labels, vectors, rates, n_terms, k=NEIGHBOURS, block=BLOCK):
        import numpy as np

        order = sorted(range(len(ids)), key=lambda i: ids[i])
        self.ids, self.labels = [ids[i] for i in order], np.array([labels[i] for i in order], np.int64)
        self.rates, self.k, n = rates, k, len(ids)
        total = sum(rates[y] for y in labels)
        self.share = sum(rates[y] for y in labels if y) / total if total else 0.0
        self.prior = PRIOR * total / max(n, 1)
        pairs = [_arrays(vectors[i]) for i in order]
        rows = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t, _ in pairs])
        terms = np.concatenate([t for t, _ in pairs]) if pairs else np.zeros(0, np.int64)
        weights = np.concatenate([w for _, w in pairs]) if pairs else np.zeros(0)
        full = np.flatnonzero(np.bincount(terms, minlength=n_terms) * block >= max(n, block))
        self.full = np.full(n_terms, -1, np.int32)
        self.full[full] = np.arange(len(full))
        at = self.full[terms]
        self.entries = at[at >= 0], rows[at >= 0], weights[at >= 0]
        self.shape, self.dense = (len(full), n), None
        order = np.flatnonzero(at < 0)
        order = order[np.argsort(terms[order], kind="stable")]
        self.rows, self.weights = rows[order], weights[order]
        self.cuts = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def __getstate__(self):
        return self.__dict__ | {"dense": None}

    def _full_rows(self):
        import numpy as np

        if self.dense is None:
            self.dense = np.zeros(self.shape)
            self.dense[self.entries[:2]] = self.entries[2]
        return self.dense

    def nearest_of(self, vectors, but=None) -> list[list[tuple[float, int]]]:
        """For each vector (cosine, row) of the k nearest examples sharing a term, best first, ties by id; never ``but``."""
        import numpy as np

        n, out, dense = len(self.ids), [], self._full_rows()
        for start in range(0, len(vectors), BATCH):
            part = [_arrays(v) for v in vectors[start:start + BATCH]]
            common, scores = np.zeros((len(part), len(dense))), np.zeros((len(part), n))
            for i, (terms, weights) in enumerate(part):
                at = self.full[terms]
                common[i, at[at >= 0]] = weights[at >= 0]
                terms, weights = terms[at < 0], weights[at < 0]
                sizes = self.cuts[terms + 1] - self.cuts[terms]
                places = np.arange(sizes.sum()) + np.repeat(self.cuts[terms] - np.cumsum(sizes) + sizes, sizes)
                scores[i] = np.bincount(self.rows[places], self.weights[places] * np.repeat(weights, sizes), minlength=n)
            scores += common @ dense
            for i, s in enumerate(scores):
                if but is not None:
                    s[but[start + i]] = 0.0
                # equal cosines must compare equal, whatever the order of their sums
                least = np.partition(s, n - self.k)[n - self.k] - 1e-11 if n > self.k else 0.0
                found = [(-round(float(s[r]), 12), int(r)) for r in np.flatnonzero((s >= least) & (s > 0))]
                out.append([(-c, r) for c, r in sorted(found)[:self.k] if c])
        return out

    def nearest(self, vector, but: int = -1) -> list[tuple[float, int]]:
        return self.nearest_of([vector], None if but < 0 else [but])[0]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of the toxic among the neighbours' distance-weighted, rate-corrected votes."""
        both = [self.prior * (1.0 - self.share), self.prior * self.share]
        for cosine, row in near:
            y = int(self.labels[row])
            both[y] += self.rates[y] * cosine * cosine / (SOFT + max(0.0, 1.0 - cosine))
        return both[1] / (both[0] + both[1])


class Model:
    """Words, their weights, example index and calibration; bounded by the sample, and the same in every task."""

    def __init__(self, terms: Terms, weights, strange: float):
        self.terms, self.weights, self.strange = terms, weights, strange
        self.examples: Examples | None = None
        self.curve, self.bare = (1.0, 0.0), 0.0

    def rest(self) -> None:
        """Give up what only judging needs and the next text builds again."""
        self.terms.number = None
        if self.examples:
            self.examples.dense = None

    def vector(self, counts, strange=()):
        """Ascending term numbers and weights of the unit vector; ``strange`` words add to the norm alone."""
        import numpy as np

        terms, n = _arrays(counts)
        w = (1.0 + np.log(n)) * self.weights[terms]
        rest = sum((1.0 + math.log(n)) ** 2 for n in strange) * self.strange ** 2
        norm = math.sqrt(float((w * w).sum()) + rest)
        return terms, w / norm if norm else w

    def fit(self, examples: list[tuple], rates: tuple[float, float]) -> "Model":
        """``examples``: (id, label, word counts); ``rates``: how many labelled rows an example of each label stands for.

        Counts are a dictionary or (ascending term numbers, counts), and empty where there is no word.
        """
        import numpy as np

        bare = [y for _, y, c in examples if not c]
        weight = sum(rates[y] for y in bare)
        self.bare = (rates[1] * sum(bare) + 0.05) / (weight + 1.0) if examples else 0.0
        full = sorted(((i, y, c) for i, y, c in examples if c), key=lambda r: r[:2])
        if not full:
            return self
        vectors = [self.vector(c) for _, _, c in full]
        index = Examples([i for i, _, _ in full], [y for _, y, _ in full], vectors, rates, len(self.weights))
        self.examples = index
        x, y, w = [], [], []
        for row, near in enumerate(index.nearest_of(vectors, range(len(full)))):
            if near:
                x.append(self._logit(index.vote(near)))
                y.append(int(index.labels[row]))
                w.append(rates[y[-1]])
        if len(set(y)) == 2:
            self.curve = _logistic(np.array(x), np.array(y), np.array(w))
        return self

    @staticmethod
    def _logit(p: float) -> float:
        p = min(max(p, 0.002), 0.998)
        return math.log(p / (1.0 - p))

    def judge(self, texts: list) -> list[tuple[float, list[tuple[float, int]]]]:
        """(score, neighbours) of every text; equal texts are judged once."""
        places = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        vectors = [self.vector(*self.terms.counts(t)) for t in places]
        near = self.examples.nearest_of(vectors) if self.examples else [[] for _ in vectors]
        a, b = self.curve
        judged = [(1.0 / (1.0 + math.exp(-(a * self._logit(self.examples.vote(n)) + b))) if n else self.bare, n)
                  for n in near]
        return [judged[places[t]] for t in texts]


def _logistic(x, y, w) -> tuple[float, float]:
    """Slope and intercept of a logistic curve with smoothed targets (Newton's method)."""
    import numpy as np

    n1, n0 = max((w * y).sum(), 1.0), max((w * (1 - y)).sum(), 1.0)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (p - target)) + 1e-3 * (beta - [1.0, 0.0])
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), grad)
        beta -= np.clip(step, -1.0, 1.0)
        if np.abs(step).max() < 1e-9:
            break
    return (max(float(beta[0]), 0.05), float(beta[1]))


def _frequencies(terms: Terms):
    """Arrow function: in how many of the task's texts each word stands; -1 counts the texts."""
    @released
    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, rows = np.zeros(terms.size, np.int64), 0
        for batch in batches:
            rows += len(batch)
            for at in range(0, len(batch), 500):
                found = [np.fromiter(terms.distinct(t), np.int64)
                         for t in batch.column("text").slice(at, 500).to_pylist()]
                n += np.bincount(np.concatenate(found), minlength=len(n))
        terms.number = None
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int64()),
                                          pa.array(np.append(n[seen], rows), pa.int64())], names=["term", "n"])
    return run


def held_out(id_col):
    return F.crc32(id_col.cast("string")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of the bounded sample, one row per distinct text, and the labelled rows per label."""
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    # at most 2 * per_label small rows
    joined = texts.join(F.broadcast(chosen), F.col("d") == F.col("doc_id")).select("doc_id", "toxic", "text")
    return (materialize(joined.withColumn("h", F.sha2("text", 256)).dropDuplicates(["h", "toxic"]).drop("h"),
                        "toxicity-examples"), totals)


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); labels of held-out ids are not read."""
    import numpy as np

    ship_package(docs.sparkSession)
    sample, totals = _sample(docs, labels, examples)
    number: dict[str, int] = {}
    known, kept, contexts = [], [0, 0], [[], []]
    # bounded: the sample's rows, without their texts
    for r in sample.toLocalIterator():
        first = first_contexts(r["text"])
        terms = np.array([number.setdefault(w, len(number)) for w in first], np.int64)
        contexts[r["toxic"]].append(terms << 32 | np.fromiter(first.values(), np.int64, len(first)))
        kept[r["toxic"]] += 1
        counts = {number[w]: n for w, n in Counter(_WORD.findall(r["text"].lower())).items()}
        known.append((r["doc_id"], r["toxic"], _arrays(counts) if counts else ()))
    rates = tuple(totals.get(y, 0) / max(kept[y], 1) for y in (0, 1))
    size = len(number)
    seen = [np.bincount(np.unique(np.concatenate(c)) >> 32, minlength=size) if c else np.zeros(size) for c in contexts]
    words = Terms(number)
    del contexts, number
    df, n_docs = np.zeros(size), 0
    if size:
        counted = (docs.select("text").mapInArrow(_frequencies(words), "term long, n long")
                   .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
        terms, n = (counted.column(c).to_numpy() for c in ("term", "n"))
        n_docs = int(n[terms < 0].sum())
        df[terms[terms >= 0]] = n[terms >= 0]
    weights = (np.log((1 + n_docs) / (1 + df)) + 1.0) * (1.0 + np.sqrt(_chi_square(*seen, *kept)))
    return Model(words, weights, math.log(1 + n_docs) + 1.0).fit(known, rates)


def _sent(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES):
    """The trained model as a broadcast: a worker reads it once, without a pickled copy beside it."""
    model = train(docs, labels, examples)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    del model
    give_back()                                 # the driver lives on through the stages that follow
    return sent


def _chi_square(neg, pos, n_neg: int, n_pos: int):
    """How far words tell the labels apart, by the contexts they have in the texts of either label."""
    import numpy as np

    a, b = np.asarray(pos, float), np.asarray(neg, float)
    c, d = n_pos - a, n_neg - b
    below = (a + b) * (c + d) * n_pos * n_neg
    return (n_pos + n_neg) * (a * d - b * c) ** 2 / np.where(below > 0, below, np.inf)


def _score(sent):
    @released
    def run(batches):
        import pyarrow as pa

        near_kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        model = sent.value
        index = model.examples
        try:
            for part in sliced(batches, ROWS):
                judged = model.judge(part.column("text").to_pylist())
                near = [[{"doc_id": index.ids[r], "similarity": s, "toxic": int(index.labels[r])} for s, r in n]
                        for _, n in judged]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([s for s, _ in judged], pa.float64()), pa.array(near, near_kind)],
                    names=["doc_id", "score", "evidence"])
        finally:
            model.rest()
    return run


def _clean(sent, at: int, threshold: float):
    """Arrow function: the rows whose text, column ``at``, scores below ``threshold``, a few hundred at a time."""
    @released
    def run(batches):
        import pyarrow as pa

        model = sent.value
        try:
            for part in sliced(batches, ROWS):
                keep = [s < threshold for s, _ in model.judge(part.column(at).to_pylist())]
                yield part.filter(pa.array(keep, pa.bool_()))
        finally:
            model.rest()
    return run


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (the neighbours that voted) for every row of ``docs``."""
    sent = _sent(docs, labels, examples)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    judged = rows.mapInArrow(_score(sent), "doc_id long, score double, evidence "
                                           "array<struct<doc_id:long,similarity:double,toxic:int>>")
    return judged.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored ``threshold`` or more; scored where they are scanned, no text is shuffled."""
    sent = _sent(docs, labels)
    return docs.mapInArrow(_clean(sent, docs.columns.index("text"), threshold), docs.schema)

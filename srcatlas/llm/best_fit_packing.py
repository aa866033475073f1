"""Best-fit packing of tokenised documents (operator 7).

Documents are tokenised where they are scanned, closed by an end id and cut only where they are longer than a
sequence.  What remains is bin packing of pieces of 1 to ``size`` tokens, solved by best fit, longest first:

* Pieces are range-sorted by length, so a piece is known by its length and its rank among pieces of that
  length: a running count inside each partition plus one small row per (partition, length).
* A superstep takes the pieces of one length, all at once, and sweeps the open gaps upwards from the first that
  they fit (the successor): a run of m equal pieces meets a run of equal gaps, the k-th piece by rank gets the
  k-th gap by rank, so no two pieces claim one gap; the gaps shrink, move to their new place in the order and
  the sweep goes on until the pieces are placed, opening new sequences only when no gap fits.  The supersteps
  run on the driver over the counts per length (``plan``), not as sweeps in Spark.
* Gaps are kept as runs (residual, first sequence, count).  The runs, not the rows, are the state between
  supersteps; it is made from the at most ``size`` counts of pieces per length, so it is bounded by the
  sequence size and not by the data.  The rows then find their runs by rank, each partition on its own.

The result is what best fit decreasing gives piece by piece.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed each time;
pieces of equal length are ranked by (id, piece, start, checksum); null ids come first; an empty table gives
an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import released, utf8_rows, word_hashes

SIZE = 2048
#: Words whose ids a worker remembers (the first it meets), and bytes of text that are split together.
REMEMBERED, SLICE = 500_000, 1 << 20
#: Words that are tokenised in one call.
JOINED = 2_000

_STATE: dict = {}
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A, 0x09, 0x0D]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


class Store:
    """Sorted 64-bit word hashes with the ids of each word in one flat array; new words wait unsorted in a small part."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]

    def __len__(self) -> int:
        return sum(len(h) for h, _, _ in self.parts)

    def find(self, hashes: np.ndarray):
        """(start, size) of each hash in ``flat``; size -1 where it is unknown."""
        start, size = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        for known, starts, sizes in self.parts:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                start[hit], size[hit] = starts[at[hit]], sizes[at[hit]]
        return start, size

    def add(self, hashes: np.ndarray, ids: list[np.ndarray], keep: bool):
        """(start, size) of new words, put behind what is used; forgotten at the next call unless ``keep``."""
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = self.used + np.cumsum(sizes) - sizes
        end = self.used + int(sizes.sum())
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(end - len(self.flat), len(self.flat) // 2), "<u4")])
        if ids:
            self.flat[self.used:end] = np.concatenate(ids)
        if keep:
            self.used = end
            self.parts[1] = self._sorted(self.parts[1], (hashes, starts, sizes))
            if len(self.parts[1][0]) > max(50_000, len(self.parts[0][0]) // 4):
                self.parts = [self._sorted(*self.parts), tuple(x[:0] for x in self.parts[1])]
        return starts, sizes

    @staticmethod
    def _sorted(a, b):
        joined = [np.concatenate(x) for x in zip(a, b)]
        order = np.argsort(joined[0], kind="stable")
        return tuple(x[order] for x in joined)


class Words:
    """Ids of texts, word by word: words end at plain white space, which no token spans.

    The tokenizer lower-cases and treats letters and marks apart, so an ASCII word is taken in lower case and a
    closing mark after letters alone by itself; the tokenizer does the rest, once for each word that a worker
    meets.  Words are told apart by 64-bit hashes.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None
        self.store = Store()

    def load(self) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def rest(self) -> None:
        """Between tasks only the words stay."""
        self.tokenizer = None

    def tokenised(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; words of letters alone are one word each to the tokenizer and go in one call."""
        if self.tokenizer is None:
            self.load()
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isascii() and w.isalpha()]
        for at in range(0, len(plain), JOINED):
            some = plain[at:at + JOINED]
            joined = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in some])], add_special_tokens=False)
            ids = np.array(joined[0].ids, "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(ends) == len(some):
                for i, a, b in zip(some, [0, *ends], ends):
                    out[i] = ids[a:b]
        alone = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(alone), JOINED):
            some = alone[at:at + JOINED]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
                out[i] = np.array(e.ids, "<u4")
        return out

    @staticmethod
    def _bounds(raw: np.ndarray, ends: np.ndarray):
        """(first, last) of every word in order, after lower-casing ``raw``'s ASCII words in place."""
        inside = ~_BLANK[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[ends] = True
        first = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]])[:len(raw)] | edge[:-1]))
        last = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]])[:len(raw)] | edge[1:])) + 1

        def count(flags):
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
            return total[last] - total[first]

        ascii_word = count(raw > 127) == 0
        in_ascii = np.repeat(ascii_word, last - first)
        upper = inside.copy()
        upper[inside] = in_ascii
        upper &= (raw >= 65) & (raw <= 90)
        raw[upper] += 32
        size = last - first
        marked = np.flatnonzero(ascii_word & (size > 1) & _MARK[raw[last - 1]] & (count(_LETTER[raw]) == size - 1))
        marks = last[marked] - 1
        last[marked] = marks
        order = np.argsort(np.concatenate([first, marks]), kind="stable")
        return np.concatenate([first, marks])[order], np.concatenate([last, marks + 1])[order]

    def _slice(self, raw: np.ndarray, ends: np.ndarray):
        raw = raw.copy()
        first, last = self._bounds(raw, ends)
        hashes, where, inverse = np.unique(word_hashes(raw, first, last), return_index=True, return_inverse=True)
        start, size = self.store.find(hashes)
        new = np.flatnonzero(size < 0)
        if len(new):
            words = [raw[a:b].tobytes().decode("utf-8") for a, b in zip(first[where[new]], last[where[new]])]
            start[new], size[new] = self.store.add(hashes[new], self.tokenised(words),
                                                   len(self.store) + len(new) <= REMEMBERED)
        size, start = size[inverse], start[inverse]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.store.flat[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(first, ends)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield ids[a:b]

    def documents(self, column):
        """The ids (unsigned 32-bit) of each text of an Arrow string column."""
        raw, ends = utf8_rows(column)
        at = 0
        while at < len(ends) - 1:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            yield from self._slice(raw[ends[at]:ends[to]], ends[at:to + 1] - ends[at])
            at = to


def _words(path: str) -> Words:
    if path not in _STATE:
        _STATE[path] = Words(path)
    return _STATE[path]


def _cut(path: str, size: int, end_id: int):
    """Arrow function: doc_id, text -> a row per piece."""
    @released
    def run(batches):
        import zlib

        import pyarrow as pa

        end = int(end_id).to_bytes(4, "little")
        step = 4 * size
        for batch in batches:
            out: list[tuple] = []
            ids_of = _words(path).documents(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of):
                ids = ids.tobytes() + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        _words(path).rest()
    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cut(tokenizer_path, size, end_id), PIECES)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over ``counts`` pieces per length: runs (length, rank, n, sequence, offset).

    The pieces of ``length`` ranked ``rank .. rank + n - 1`` (from 0) go to the sequences ``sequence ..
    sequence + n - 1``, at ``offset``.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, deque] = {}
    residuals: list[int] = []
    sequences = 0

    def give(residual: int, first: int, n: int) -> None:
        if residual:
            if residual not in gaps:
                insort(residuals, residual)
                gaps[residual] = deque()
            gaps[residual].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(residuals, length)
            if at == len(residuals):
                # one by one, a new sequence would be filled before the next is opened
                opened = max(1, left // (size // length))
                give(size, sequences, opened)
                sequences += opened
                continue
            residual = residuals[at]
            first, n = gaps[residual].popleft()
            if n > left:
                gaps[residual].appendleft((first + left, n - left))
                n = left
            if not gaps[residual]:
                del gaps[residual]
                residuals.pop(at)
            runs.append((length, rank, n, first, size - residual))
            give(residual - length, first, n)
            rank += n
            left -= n
    return runs


def _place(runs: list[tuple[int, int, int, int, int]], names: list[str]):
    """Arrow function: finds the run of each (length, rank) by binary search."""
    @released
    def run(batches):
        import pyarrow as pa

        length, rank, _, sequence, offset = (np.array(c, np.int64) for c in zip(*sorted(runs))) if runs else [[]] * 5
        starts = {n: i for i, n in reversed(list(enumerate(length)))}
        stops = {n: i + 1 for i, n in enumerate(length)}
        for batch in batches:
            sizes = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            found = np.zeros(len(sizes), np.int64)
            for n in np.unique(sizes):
                of = sizes == n
                a, b = starts[n], stops[n]
                found[of] = a + np.searchsorted(rank[a:b], ranks[of], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(sequence[found] + ranks - rank[found]), pa.array(offset[found])],
                names=[*names, "sequence_id", "offset"])
    return run


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` with sequence_id and offset; offsets in a sequence are gapless from 0."""
    ship_package(pieces.sparkSession)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = materialize(pieces.repartitionByRange("length", *order).withColumn("pid", F.spark_partition_id()),
                        "pieces-by-length")
    local = F.row_number().over(Window.partitionBy("pid", "length").orderBy(*order))
    per_part = dealt.groupBy("pid", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = (per_part.withColumn("n0", F.sum("n").over(earlier)).where("n0 is not null")
              .select("pid", "length", "n0"))
    # at most `size` rows, whatever the data
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = (dealt.withColumn("k", local).join(before, ["pid", "length"], "left")
              .withColumn("rank", F.col("k") - 1 + F.coalesce("n0", F.lit(0))))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return (ranked.select(*names, "rank")
            .mapInArrow(_place(plan(counts, size), names), PIECES + ", sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    # written once: the range sort below samples its input first, which would tokenise it twice
    return pack(materialize(cut(docs, tokenizer_path, size, end_id, id_col, text_col), "pieces"), size)

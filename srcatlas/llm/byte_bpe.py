"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition (operator 9).

A task splits its texts by the tokenizer's pattern and hands the words it has not met yet to a DuckDB that
lives in the task's process.  There every byte of a word is a row (word, position, token).  A recursive query
joins neighbouring rows with the merge table (all pairs of tokens whose bytes together are a token), contracts
in every word the leftmost pair of minimum rank, and repeats until no word has a pair left.  Ordered
aggregation turns the rows that remain into the word's ids and, joined with the vocabulary, its decoded bytes;
a document's ids and bytes are those of its words in order.  Words that are tokens themselves keep their id,
as in the public library.  A worker remembers the first ``REMEMBERED`` words and asks in batches of ``BATCH``,
which bounds its memory; decoded bytes that are the word's own are not kept a second time.

A contraction a turn makes a word of n bytes cost n turns of n rows, so words over ``LONG`` bytes (runs of
one kind of character, not words of a language) are contracted by the same rule with a heap instead.

Defined results: null and empty texts have no tokens; every row gives one row, repeated rows and null ids
included; special-token strings are ordinary text; an empty table gives an empty result; columns other than
the id and the text are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import utf8_rows

REMEMBERED, BATCH, LONG = 600_000, 20_000, 256
#: Characters of the texts that are split together.
CHARACTERS = 3_000_000

#: A position is ``word * 256 + byte``, narrow integers throughout; the key of a pair is its rank, then its byte.
CONTRACT = """
WITH RECURSIVE state(turn, pos, tok) AS (
    SELECT 0, pos, tok FROM start
    UNION ALL
    (WITH pair AS (
        SELECT turn, pos, tok, lag(pos) OVER w AS before,
               CASE WHEN lead(pos) OVER w >> 8 = pos >> 8 THEN tok * 4294967296 + lead(tok) OVER w END AS ab FROM state
        WINDOW w AS (ORDER BY pos)),
    ranked AS (
        SELECT turn, pos, tok, before, pos >> 8 AS word, merged * 256 + (pos & 255) AS key
        FROM pair LEFT JOIN merges USING (ab)),
    best AS (SELECT word, min(key) AS key FROM ranked WHERE key IS NOT NULL GROUP BY word)
    SELECT turn + 1, pos, CASE WHEN r.key = best.key THEN (best.key >> 8)::INTEGER ELSE tok END
    FROM ranked r JOIN best ON r.word = best.word
    WHERE before IS NULL OR before <> (r.word << 8) + (best.key & 255))),
last AS (SELECT pos >> 8 AS word, max(turn) AS turn FROM state GROUP BY ALL)
SELECT last.word, list(tok ORDER BY pos) AS ids, list(bytes ORDER BY pos) AS decoded
FROM state JOIN last ON pos >> 8 = last.word AND state.turn = last.turn JOIN vocabulary ON tok = id
GROUP BY last.word ORDER BY last.word"""

_STATE: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(a, b, merged) for every pair of tokens whose bytes together are a token; the rank of a pair is ``merged``."""
    return [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks]


def contract_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of a long word: always the leftmost pair of minimum rank, found with a heap."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n and (r := ranks.get(word[left:end[after[left]]])) is not None:
                heapq.heappush(heap, (r, left, end[after[left]]))
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


class _Known(dict):
    """Ids (little-endian) of the words remembered; ``fresh`` has those of the texts at hand that are not."""

    fresh: dict[str, bytes] = {}

    def __missing__(self, w: str) -> bytes:
        return self.fresh[w]


class Codec:
    """Word encoder of one worker: merge table and vocabulary in DuckDB, and the words met so far."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.known, self.odd = _Known(), {}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        a, b, merged = zip(*merge_table(self.ranks))
        pairs = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
                          "merged": pa.array(merged, pa.int64())})
        words = pa.table({"id": pa.array(list(self.tokens), pa.int32()), "bytes": pa.array(self.tokens.values(), pa.binary())})
        self.db.register("pairs", pairs)
        self.db.register("words", words)
        self.db.execute("CREATE TABLE merges AS SELECT a * 4294967296 + b AS ab, merged FROM pairs")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM words")

    def learn(self, words: list[str]) -> dict[str, tuple[bytes, bytes | None]]:
        """(ids, decoded bytes, or None where they are the word's own) of each word."""
        import numpy as np
        import pyarrow as pa

        out, asked = {}, []
        for w in words:
            raw = w.encode("utf-8")
            if raw in self.ranks:
                ids = [self.ranks[raw]]
            elif len(raw) > LONG:
                ids = contract_long(raw, self.ranks)
            else:
                asked.append((w, raw))
                continue
            decoded = b"".join(map(self.tokens.__getitem__, ids))
            out[w] = (np.array(ids, "<u4").tobytes(), None if decoded == raw else decoded)
        byte_ids = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        for at in range(0, len(asked), BATCH):
            some = asked[at:at + BATCH]
            sizes = np.array([len(raw) for _, raw in some])
            starts = np.cumsum(sizes) - sizes
            places = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(some)) * 256 - starts, sizes)
            start = pa.table({"pos": places.astype(np.int32),
                              "tok": byte_ids[np.frombuffer(b"".join(raw for _, raw in some), np.uint8)]})
            self.db.register("start", start)
            rows = self.db.sql(CONTRACT).to_arrow_table()
            ids = rows.column("ids").combine_chunks()
            ends = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            # the tokens' bytes lie one after the other, those of a word without a gap
            back, cuts = utf8_rows(rows.column("decoded").combine_chunks().values)
            back, cuts, ends = back.tobytes(), cuts[ends].tolist(), (ends * 4).tolist()
            for i, word in enumerate(rows.column("word").to_pylist()):
                w, raw = some[word]
                decoded = back[cuts[i]:cuts[i + 1]]
                out[w] = (flat[ends[i]:ends[i + 1]], None if decoded == raw else decoded)
        return out

    def documents(self, texts: list[str | None]):
        """(ids as little-endian bytes, decoded bytes) of each text."""
        known, at = self.known, 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < CHARACTERS:
                text = texts[at] or ""
                split.append(self.split(text))
                size += len(text)
                at += 1
            fresh = self.learn(list(set().union(*split).difference(known)))
            ids, odd = {w: x for w, (x, _) in fresh.items()}, {w: y for w, (_, y) in fresh.items() if y is not None}
            # frequent words come early, so what is remembered first stays
            if len(known) + len(fresh) <= REMEMBERED:
                known.update(ids)
                self.odd.update(odd)
                ids = {}
            odd = self.odd | odd
            for words in split:
                known.fresh = ids
                if odd and not odd.keys().isdisjoint(words):
                    decoded = b"".join([odd[w] if w in odd else w.encode("utf-8") for w in words])
                else:
                    decoded = "".join(words).encode("utf-8")
                yield b"".join(map(known.__getitem__, words)), decoded


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _STATE:
        _STATE[path, pattern] = Codec(path, pattern)
    return _STATE[path, pattern]


def _encode(path: str, pattern: str, whole: bool):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            both = codec(path, pattern).documents(batch.column("text").to_pylist())
            if whole:
                ids, out = zip(*[(np.frombuffer(i, "<u4").astype(np.int32), o) for i, o in both]) if len(batch) else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(list(ids), pa.list_(pa.int32())), pa.array(out, pa.binary())],
                    names=["doc_id", "ids", "decoded"])
                continue
            n, ids, out = zip(*[(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(o).hexdigest())
                                for i, o in both]) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded, the bytes that the ids stand for."""
    return _rows(docs, id_col, text_col).mapInArrow(_encode(ranks_path, pattern, True),
                                                    "doc_id long, ids array<int>, decoded binary")


def digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the decoded bytes."""
    return _rows(docs, id_col, text_col).mapInArrow(
        _encode(ranks_path, pattern, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Periodic run detection in word sequences (operator 13).

A run is a stretch of consecutive words with smallest period q and length at least ``max(least, 2 * q)`` that
no neighbouring word extends keeping period q.

A suffix automaton reads the words.  Its suffix-link tree is kept as a link-cut forest whose preferred paths
join states of one last occurrence: appending a word makes the path from the root to the new prefix's state
one path, last seen here.  While doing so, access meets the old paths one after the other; each is a segment
of suffixes that ended last at one earlier place.  If the distance d to that place is at most the length of
the segment's longest suffix, that suffix overlaps or touches its own copy, so a square of period d ends
here, and since no shorter distance came first, d is its smallest period.  A square is extended in both
directions to its run once.  Every run shows itself this way at the end of its first square: a word sequence
that is not a power occurs in its own square at both ends only.  A document costs O(n log n) amortised.

The automaton reads only where a run can lie.  In a run at least ``least / 2`` consecutive words equal those q
before, so its words are covered by word n-grams of that size that recur within half of any stretch that
holds the run; stretches not covered so, found by hashes over many documents at once, hold no run.  What
remains is compared word by word, never by hash.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; rows are judged one
by one, so repeated rows and null ids give a row each; a word that recurs through a whole document is a run
of period 1; equal lengths need no rule, as all runs are listed by start, then period; a document is held
whole by one task, in memory proportional to its words; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import MULTIPLIER, mix, released, utf8_rows, word_hashes

LEAST = 12
#: Bytes of text worked on at once (a longer document alone).
SLICE = 1 << 22
#: Rounds that narrow the stretches; any number is right, later ones find little.
ROUNDS = 4
SPACE = b" \t\n\x0b\x0c\r"


class LastSeen:
    """Suffix automaton of a growing word sequence and, on its link tree, the paths of common last occurrence.

    ``left``, ``right`` and ``up`` are splay trees by depth, one per path; the ``up`` of a tree's root leads to
    the path above it.  ``seen`` counts at the root of a path's tree: the place where all its states ended last.
    """

    def __init__(self):
        self.next, self.link, self.size, self.last = [{}], [-1], [0], 0
        self.left, self.right, self.up, self.seen = [-1], [-1], [-1], [-1]

    def _state(self, following: dict, link: int, size: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        for tree in (self.left, self.right, self.up, self.seen):
            tree.append(-1)
        return len(self.size) - 1

    def append(self, word: int, place: int) -> list[tuple[int, int]]:
        """Add a word; (distance, length) of each segment that overlaps or touches its last occurrence."""
        following, link, size = self.next, self.link, self.size
        p, new = self.last, self._state({}, 0, size[self.last] + 1)
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p >= 0:
            q = following[p][word]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = self._state(dict(following[q]), link[q], size[p] + 1)
                while p >= 0 and following[p].get(word) == q:
                    following[p][word] = copy
                    p = link[p]
                link[q] = link[new] = copy
                self._put_above(copy, q)
        self.last, self.up[new] = new, link[new]
        return self._access(new, place)

    def _put_above(self, copy: int, state: int) -> None:
        """``copy`` joins the path of ``state``, just above it: so far both ended last at the same place."""
        self._splay(state)
        above = self.left[state]
        self.left[copy] = above
        if above >= 0:
            self.up[above] = copy
        self.left[state], self.up[copy] = copy, state

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        while True:
            p = up[x]
            if p < 0 or left[p] != x and right[p] != x:
                return
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            top = g if inner else p
            above = up[top]
            at_root = above < 0 or left[above] != top and right[above] != top
            if inner:
                self._turn(p if (left[g] == p) == (left[p] == x) else x)
            self._turn(x)
            if at_root:
                self.seen[x] = self.seen[top]
                return

    def _turn(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child >= 0:
            up[child] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _access(self, state: int, place: int) -> list[tuple[int, int]]:
        right, up, seen, size = self.right, self.up, self.seen, self.size
        found, below, x = [], state, up[state]
        while x >= 0:
            self._splay(x)
            deeper = right[x]
            if deeper >= 0:
                seen[deeper] = seen[x]
            right[x] = below
            if place - seen[x] <= size[x]:
                found.append((place - seen[x], size[x]))
            below, x = x, up[x]
        self._splay(state)
        seen[state] = place
        return found


def runs_of(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, by start, then period."""
    seen, n, out, upto = LastSeen(), len(words), [], {}
    for i, word in enumerate(words):
        for d, length in seen.append(word, i):
            if upto.get(d, -1) >= i:
                continue                        # inside the last run of this period
            first, end = i - length, i + 1
            while first >= d and words[first] == words[first - d]:
                first -= 1
            while end < n and words[end] == words[end - d]:
                end += 1
            start, upto[d] = first + 1 - d, end - 1
            if end - start >= max(least, 2 * d):
                out.append((start, end - start, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def word_places(raw, ends):
    """First bytes and ends of all words of texts ``raw[ends[i]:ends[i + 1]]``, and the n + 1 word offsets."""
    import numpy as np

    space = np.zeros(256, bool)
    space[list(SPACE)] = True
    blank = space[raw]
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    inside = ends[(ends > 0) & (ends < len(raw))]
    before[inside], after[inside - 1] = True, True
    first = np.flatnonzero(~blank & before)
    return first, np.flatnonzero(~blank & after) + 1, np.searchsorted(first, ends)


def stretches(hashes, offsets, least: int = LEAST, rounds: int = ROUNDS):
    """(first word, size) of the stretches of the word sequences in which alone runs can lie."""
    import numpy as np

    gram = max(1, -(-least // 2))
    first, size = offsets[:-1], np.diff(offsets)
    first, size = first[size >= least], size[size >= least]
    for _ in range(rounds):
        total = int(size.sum())
        if not total:
            break
        group = np.repeat(np.arange(len(size)), size)
        starts = np.cumsum(size) - size
        word = np.arange(total) - np.repeat(starts - first, size)
        h = hashes[word]
        with np.errstate(over="ignore"):
            key = group[:total - gram + 1].astype(np.uint64) * MULTIPLIER
            for k in range(gram):
                key = key * np.uint64(0x100000001B3) + h[k:total - gram + 1 + k]
            key = mix(key)
        whole = np.flatnonzero(group[:total - gram + 1] == group[gram - 1:])
        # most n-grams are alone in a bucket of their hash; only the others are sorted
        bits = max(4, int(total).bit_length() + 2)
        bucket = (key[whole] >> np.uint64(64 - bits)).astype(np.int64)
        at = whole[(np.bincount(bucket, minlength=1 << bits) > 1)[bucket]]
        order = at[np.argsort(key[at], kind="stable")]
        a, b = order[:-1], order[1:]
        near = (key[a] == key[b]) & (group[a] == group[b]) & (2 * (b - a) <= size[group[a]])
        step = np.zeros(total + 1, np.int64)
        marked = np.unique(np.concatenate([a[near], b[near]]))
        np.add.at(step, marked, 1)
        np.add.at(step, marked + gram, -1)
        covered = np.cumsum(step[:-1]) > 0
        edge = np.ones(total, bool)
        edge[1:] = (covered[1:] != covered[:-1]) | (group[1:] != group[:-1])
        begin = np.flatnonzero(edge)
        extent = np.diff(np.append(begin, total))
        kept = covered[begin] & (extent >= least)
        first, size = word[begin[kept]], extent[kept]
        if int(size.sum()) == total:
            break
    return first, size


def _work(raw, ends, least: int):
    """The runs of each text and its collapsed words as (bytes, n + 1 offsets)."""
    import numpy as np

    first, last, offsets = word_places(raw, ends)
    n = len(ends) - 1
    runs: list[list] = [[] for _ in range(n)]
    kept = np.ones(len(first), bool)
    if len(first):
        at, size = stretches(word_hashes(raw, first, last), offsets, least)
        owner = np.searchsorted(offsets, at, "right") - 1
        data = raw.tobytes() if len(at) else b""
        for w, m, doc in zip(at.tolist(), size.tolist(), owner.tolist()):
            ids: dict[bytes, int] = {}
            words = [ids.setdefault(data[i:j], len(ids)) for i, j in zip(first[w:w + m].tolist(), last[w:w + m].tolist())]
            for start, length, period in runs_of(words, least):
                kept[w + start + period:w + start + length] = False
                runs[doc].append((w + start - int(offsets[doc]), length, period))
    # each kept word stays with the blank after it, the last one of a text without
    word = np.flatnonzero(kept)
    doc = np.searchsorted(offsets, word, "right") - 1
    more = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
    step = np.zeros(len(raw) + 2, np.int8)
    step[first[word]] += 1
    step[last[word] + more] -= 1
    mask = np.cumsum(step[:len(raw)], dtype=np.int8) > 0
    space = np.arange(256, dtype=np.uint8)
    space[list(SPACE)] = 32
    sizes = np.append(0, np.cumsum(mask, dtype=np.int64))
    return runs, space[raw[mask]], sizes[ends]


def _find(least: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            raw, ends = utf8_rows(batch.column("text"))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
                runs, text, offsets = _work(raw[ends[at]:ends[to]], ends[at:to + 1] - ends[at], least)
                flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(kind.value_type))
                held = pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32())
                # the type of the batch's own texts, so that sizes beyond 2 GB pass as they came
                wide = pa.types.is_large_string(batch.column("text").type)
                words = pa.Array.from_buffers(
                    batch.column("text").type, to - at,
                    [None, pa.py_buffer(offsets.astype(np.int64 if wide else np.int32).tobytes()),
                     pa.py_buffer(np.ascontiguousarray(text))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), pa.ListArray.from_arrays(held, spans, type=kind), words],
                    names=["doc_id", "runs", "collapsed"])
                at = to
    return released(run)


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period in words) and collapsed, the text with repeats dropped.

    A word is dropped if a run contains it after that run's first period; kept words are joined by one space.
    """
    ship_package(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(_find(least), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and hashes of runs and collapsed text."""
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.when(F.size("runs") > 0, F.array_min(ranked))
    length, period = -best["l"], best["p"]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["s"].alias("start"),
                        length.alias("length"), period.alias("period"),
                        F.floor(length * 1000 / period).alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))

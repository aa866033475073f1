"""N-gram Jaccard self-join by adaptive multi-match prefixes (operator 6).

A text's set are its distinct shingles of ``N`` words; two texts link when their sets' Jaccard similarity is
at least the threshold.  Sets are numpy arrays of 64-bit shingle hashes; equal sets are one class, represented
by the smallest id, and only representatives are joined.

1. Frequencies.  Representatives are taken in blocks of bounded size; a block's hashes are dealt by range into
   buckets, and each bucket counts in how many sets a hash occurs.  A hash that occurs once can be in no
   intersection, so only shared hashes go back to their block.  A set that shares fewer hashes than the overlap
   any partner needs is done: it has no partner.
2. Prefixes.  The shared hashes of a set are ordered by (frequency, hash), the same order everywhere.  If any
   partner must share at least ``a`` of a set's ``m`` shared hashes, its first ``m - a + l`` hashes hold at
   least ``l`` of them, for every ``l``.  Each set picks its own ``l``: a longer prefix reads more postings but
   demands more matches, and the cheaper choice by the frequencies is taken.  Two sets with prefixes ``l`` and
   ``k`` must share ``min(l, k)`` prefix hashes.
3. Links.  Only what connects matters for the components.  First every posting list is compared with one pivot
   (one pair per entry, so a group of g near copies costs g pairs, not g * g), ``PIVOTS`` times with different
   pivots, and the links found are contracted.  Then the lists that still span several components are joined
   in full: pairs within a component, of sizes that cannot be similar, with fewer than ``min(l, k)`` common
   prefix hashes or with too few hashes in the same ranges are left out inside the join, and the rest are
   verified exactly.  A link between different
   components cannot escape, whatever the pivots did.

Defined results: texts without words (null, empty, white space) have size 0 and link with nothing; fewer words
than ``N`` are one shingle; repeated rows are in one class; rows with a null id join a class of equal sets but
represent none, and their component is null if no row of the class has an id; rows with one id and several
texts are one node, linked by any of them; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import MULTIPLIER, ascii_lower_bytes, mix, released, utf8_rows, without, word_hashes
from .components import components

N, PERCENT = 4, 85
#: Hashes of a block and of a bucket: what one task holds at a time.
BLOCK, BUCKET = 500_000, 500_000
#: Bytes of text hashed at a time.
SLICE = 1 << 20
#: Largest l, and the cost of verifying a candidate per hash of the set, against reading a posting.
MOST_MATCHES, VERIFY = 8, 0.05
#: How often the posting lists are compared with one pivot before they are joined in full.
PIVOTS = 3

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shingle_sets(raw: np.ndarray, ends: np.ndarray, n: int = N):
    """(hashes, cuts): the sorted distinct shingles of row i are ``hashes[cuts[i]:cuts[i + 1]]``."""
    raw = ascii_lower_bytes(raw)
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    before = np.concatenate([[False], inside[:-1]])[:len(raw)]
    after = np.concatenate([inside[1:], [False]])[:len(raw)]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    words = word_hashes(raw, first, last)
    word_cuts = np.searchsorted(first, ends)
    with np.errstate(over="ignore"):
        m = len(words) - n + 1
        if m > 0:
            joined = words[:m].copy()
            for j in range(1, n):
                joined = joined * MULTIPLIER + words[j:m + j]
            joined = mix(joined)
        sets = []
        for a, b in zip(word_cuts[:-1], word_cuts[1:]):
            if b - a >= n:
                s = np.sort(joined[a:b - n + 1])
                sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:
                whole = np.uint64(b - a)
                for w in words[a:b]:
                    whole = whole * MULTIPLIER + w
                sets.append(mix(np.array([whole], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def _batch_sets(column, n: int):
    """The sets of an Arrow text column, hashed in slices of bounded size."""
    raw, ends = utf8_rows(column)
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        yield from shingle_sets(raw[ends[at]:ends[to]], ends[at:to + 1] - ends[at], n)
        at = to


def _signatures(n: int):
    """Arrow function: doc_id and a 128-bit signature of the set."""
    @released
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            with np.errstate(over="ignore"):
                for s in _batch_sets(batch.column("text"), n):
                    rows.append((len(s), int(s.sum(dtype=np.uint64).astype(np.int64)),
                                 int(mix(s ^ MULTIPLIER).sum(dtype=np.uint64).astype(np.int64))))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c, pa.int64()) for c in columns],
                                             names=["doc_id", "n_shingles", "s1", "s2"])
    return run


BLOCKS = "block long, bucket int, tokens binary, rows binary, frequencies binary"


def _packed(tokens: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte plane by byte plane, so that compression finds the zero bytes."""
    steps = np.diff(tokens, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u8").ravel(), dtype=np.uint64)


def _to_blocks(n: int, buckets: int):
    """Arrow function: texts -> one row per block and bucket, and a row (bucket -1) of the block's ids and sizes."""
    def block_of(number: int, ids: list[int], sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        rows = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, rows = tokens[order], rows[order]
        yield number, -1, np.array(ids, "<i8").tobytes(), sizes.astype("<i8").tobytes(), b""
        width = (1 << 64) // buckets + 1
        cuts = np.searchsorted(tokens, np.array([min(i * width, (1 << 64) - 1) for i in range(buckets)], np.uint64))
        cuts = np.append(cuts, len(tokens))
        kind = "<u2" if len(sets) <= 65_536 else "<u4"
        for b in range(buckets):
            part = slice(cuts[b], cuts[b + 1])
            if cuts[b + 1] > cuts[b]:
                yield number, b, _packed(tokens[part]), rows[part].astype(kind).tobytes(), b""

    @released
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def batch_of(rows):
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                              names=["block", "bucket", "tokens", "rows", "frequencies"])

        ids, sets, held = [], [], 0
        for batch in batches:
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), _batch_sets(batch.column("text"), n)):
                if held + len(s) > BLOCK and ids:
                    yield batch_of(list(block_of(number, ids, sets)))
                    number, ids, sets, held = number + 1, [], [], 0
                ids.append(doc_id)
                sets.append(s)
                held += len(s)
        if ids:
            yield batch_of(list(block_of(number, ids, sets)))
    return run


def _count(pdf):
    """Pandas function of one bucket: the hashes that several sets have, with their frequency, back to the blocks."""
    import pandas as pd

    if pdf["bucket"].iloc[0] < 0:
        return pdf
    tokens = [_unpacked(t) for t in pdf["tokens"]]
    _, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    frequency, at, out = counts[inverse], 0, []
    for block, bucket, own, rows in zip(pdf["block"], pdf["bucket"], tokens, pdf["rows"]):
        of = frequency[at:at + len(own)]
        at += len(own)
        shared = of > 1
        if shared.any():
            kind = "<u2" if len(rows) == 2 * len(own) else "<u4"
            out.append((block, bucket, _packed(own[shared]), np.frombuffer(rows, kind)[shared].astype("<u4").tobytes(),
                        np.minimum(of[shared], 2 ** 32 - 1).astype("<u4").tobytes()))
    return pd.DataFrame(out, columns=["block", "bucket", "tokens", "rows", "frequencies"])


def best_matches(m: int, need: int, frequency: np.ndarray) -> int:
    """The l whose prefix costs least: postings read, and candidates (at most postings / l) verified."""
    reads = np.cumsum(frequency - 1.0)
    most = min(MOST_MATCHES, need)
    matches = np.arange(1, most + 1)
    postings = reads[np.minimum(m - need + matches, m) - 1]
    return int(matches[np.argmin(postings + postings / matches * VERIFY * m)])


def _prefixes(percent: int):
    """Pandas function of one block: sets that may have a partner, in global order, with their l and prefix."""
    def run(pdf):
        import pandas as pd

        head = pdf[pdf["bucket"] < 0].iloc[0]
        ids, sizes = np.frombuffer(head["tokens"], "<i8"), np.frombuffer(head["rows"], "<i8")
        parts = pdf[pdf["bucket"] >= 0]
        out = []
        if len(parts):
            tokens = np.concatenate([_unpacked(t) for t in parts["tokens"]])
            rows = np.concatenate([np.frombuffer(r, "<u4") for r in parts["rows"]])
            frequency = np.concatenate([np.frombuffer(f, "<u4") for f in parts["frequencies"]])
            need = -(-percent * sizes // 100)
            shared = np.bincount(rows, minlength=len(ids))
            useful = (shared >= need)[rows]
            tokens, rows, frequency = tokens[useful], rows[useful], frequency[useful]
            order = np.lexsort((tokens, frequency, rows))
            tokens, rows, frequency = tokens[order].astype(np.int64), rows[order], frequency[order]
            cuts = np.searchsorted(rows, np.arange(len(ids) + 1))
            for i in np.flatnonzero((shared >= need) & (sizes > 0)):
                own, of = tokens[cuts[i]:cuts[i + 1]], frequency[cuts[i]:cuts[i + 1]]
                m, a = len(own), int(need[i])
                matches = best_matches(m, a, of)
                ranges = np.bincount(own.view(np.uint64) >> np.uint64(58), minlength=64)
                out.append((int(ids[i]), int(sizes[i]), m, matches, own[:m - a + matches], np.sort(own), ranges))
        return pd.DataFrame(out, columns=["id", "n", "m", "l", "prefix", "shared", "ranges"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; shared hashes are all that an intersection can hold."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b"))


def _fits(na, ma, nb, mb, percent: int):
    """Whether sets of ``n`` hashes, ``m`` of them shared with any other set, can be similar enough."""
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & ((100 + percent) * F.least(ma, mb) >= percent * (na + nb)))


def links(sets: DataFrame, percent: int = PERCENT, pivots: int = PIVOTS) -> DataFrame:
    """(id, component) of the linked sets; ``sets`` has id, n, m, l, prefix, shared, ranges."""
    postings = sets.select("id", "n", "m", "l", F.explode("prefix").alias("token"))
    found, member = None, None
    # the middle of a group of near copies has few hashes of its own: it links with more of them than an outlier
    middle = F.floor((F.col("n") - F.col("m")) * 50 / F.col("n"))
    for turn in range(pivots):
        lists = postings if member is None else _undecided(postings, member)
        best = F.min(F.struct(middle.alias("r"), F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "m")).alias("p")
        pivot = lists.groupBy("token").agg(best, F.count("*").alias("entries")).where("entries > 1")
        pairs = (lists.join(pivot, "token").where(F.col("id") != F.col("p.id"))
                 .where(_fits(F.col("n"), F.col("m"), F.col("p.n"), F.col("p.m"), percent))
                 .select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct())
        if member is not None:
            pairs = _apart(pairs, member)
        near = materialize(_verified(pairs, sets, percent), "links")
        found = near if found is None else found.unionByName(near)
        member = components(found)
    rest = _undecided(postings, member).join(sets.select("id", "prefix", "ranges"), "id")
    columns = ("id", "n", "m", "l", "c", "prefix", "ranges")
    x = rest.select("token", *[F.col(c).alias(c + "a") for c in columns])
    y = rest.select("token", *[F.col(c).alias(c + "b") for c in columns])
    # a pair is met at each prefix hash that it shares, and taken at the first of them, if there are enough
    both = F.array_intersect("prefixa", "prefixb")
    # two sets share in each of 64 ranges of hashes at most the smaller of their counts
    most = F.aggregate(F.zip_with("rangesa", "rangesb", lambda u, v: F.least(u, v)), F.lit(0), lambda a, i: a + i)
    pairs = (x.join(y, (x["token"] == y["token"]) & (F.col("ida") < F.col("idb")) & (F.col("ca") != F.col("cb"))
                    & _fits(F.col("na"), F.col("ma"), F.col("nb"), F.col("mb"), percent)
                    & (F.get(both, F.lit(0)) == x["token"]) & (F.size(both) >= F.least("la", "lb"))
                    & ((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))))
             .select(F.col("ida").alias("a"), F.col("idb").alias("b")))
    late = materialize(_verified(pairs, sets, percent), "links")
    if late.isEmpty():
        return member
    return components(found.unionByName(late))


def _apart(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component yet."""
    a, b = (member.select(F.col("id").alias(x), F.col("component").alias("c" + x)) for x in "ab")
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _undecided(postings: DataFrame, member: DataFrame) -> DataFrame:
    """Postings of the lists that span several components, with the component as ``c``."""
    known = (postings.join(member.select(F.col("id").alias("i"), "component"), F.col("id") == F.col("i"), "left")
             .withColumn("c", F.coalesce("component", "id")).drop("i", "component"))
    several = (known.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
               .select("token"))
    return known.join(several, "token")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
            percent: int = PERCENT) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = materialize(texts.mapInArrow(_signatures(n), "doc_id long, n_shingles long, s1 long, s2 long"), "signatures")
    key = ["n_shingles", "s1", "s2"]
    groups = signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    total = groups.where("rep is not null").agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    # of each class only the representative goes on; sorted, so that a task that runs again makes the same blocks
    spare = (signed.join(groups, key).where("doc_id is not null and doc_id <> rep").select(F.col("doc_id").alias("d"))
             .distinct().join(groups, F.col("d") == F.col("rep"), "left_anti"))
    worded = texts.where(F.col("doc_id").isNotNull())
    kept = without(worded, materialize(spare, "copies"), F.col("doc_id") == F.col("d")).sortWithinPartitions("doc_id")
    blocks = kept.mapInArrow(_to_blocks(n, buckets), BLOCKS)
    own = F.when(F.col("bucket") < 0, F.col("block")).alias("own")
    counted = blocks.groupBy("bucket", own).applyInPandas(_count, BLOCKS)
    sets = materialize(counted.groupBy("block").applyInPandas(
        _prefixes(percent), "id long, n long, m long, l int, prefix array<long>, shared array<long>, "
        "ranges array<int>"), "shared-shingles")
    member = links(sets, percent)
    named = (groups.join(member, F.col("rep") == F.col("id"), "left")
             .select(*key, F.coalesce("component", "rep").alias("component_id")))
    return (signed.join(named, key, "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id"))
                    .otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
             percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest id; texts without words all stay."""
    found = materialize(classes(docs, id_col, text_col, n, percent), "near-classes")
    dropped = found.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return without(docs, dropped, F.col(id_col) == F.col("__id"))

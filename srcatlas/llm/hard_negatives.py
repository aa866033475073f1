"""Hard-negative mining by Strassen products of anchor and candidate tiles (operator 12).

Components are quantised to integers (``floor(scale * x)``).  Candidates are dealt into tiles and anchors into
blocks of bounded size; every block meets every tile once per pass, and the block's scores against the tile
are one integer matrix product, computed by Strassen's recursion: odd sides are padded with a zero row or
column, seven half-size products replace eight, and all sums and differences are integer additions, so the
scores are exact.

The first pass keeps, per anchor and tile, a heap of the best rows of the anchor's label; heaps merge by
rank into the anchor's positives.  In the second pass the blocks carry the positives' scores, and every anchor
and positive keeps a heap of the best rows of other labels whose score lies in the window
``low * positive <= 100 * score <= high * positive``; these merge by rank as well.  No heap holds more than
``k`` rows, no task more than a tile, a block and their scores.

int64 is exact as long as no score can leave its range, which the widest vector and the largest component
prove beforehand; otherwise the same products run over unbounded integers, and scores travel as decimals.

Defined results: rows whose id, label or vector is null, or whose vector is empty or holds null, NaN or
infinite components, take no part; a component beyond 2**57 after scaling counts as 2**57; rows of different
width have no score; rows with the anchor's own id are none of its candidates; a repeated row counts as often
as it occurs, a repeated anchor is mined once; ties go to the smaller id; an anchor without positives, or a
positive without rows in its window (as for negative scores), gives no rows; a score beyond a long is given
as the nearest long; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package

#: Cells of a candidate tile and of an anchor block (rows x width); both bound what one task holds.
TILE, BLOCK = 1 << 18, 1 << 14
#: Products with a side this short are taken directly.
LEAF = 32
LARGEST = 1 << 57


def _even(a):
    """The matrix with a zero row or column where a side is odd (for objects, zeros are Python's)."""
    import numpy as np

    out = np.zeros((a.shape[0] + (a.shape[0] & 1), a.shape[1] + (a.shape[1] & 1)), a.dtype)
    out[:a.shape[0], :a.shape[1]] = a
    return out


def strassen(a, b, leaf: int = LEAF):
    """The exact product of two integer matrices (numpy, int64 or object)."""
    import numpy as np

    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if (m | k | n) & 1:
        a, b = _even(a), _even(b)
    i, j, h = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    out = np.empty((2 * i, 2 * h), a.dtype)
    c11, c12, c21, c22 = out[:i, :h], out[:i, h:], out[i:, :h], out[i:, h:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


def quantised(rows: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, v (array of long), dim; only the rows that take part."""
    return (rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        F.transform(F.col(vec_col), lambda c: c.cast("double")).alias("x"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0)
                   & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
            .select("id", "label", F.transform("x", lambda c: F.least(F.greatest(
                F.floor(c * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("long")).alias("v"),
                    F.size("x").alias("dim")))


def _ints(column, dtype):
    """An Arrow list column of one width as a matrix."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column))).astype(dtype)


def _tiles(batches):
    """(tile or None, block) pairs of a partition sorted by (dim, part, kind, blk): its tiles, each met by all blocks."""
    import itertools

    import pyarrow as pa

    def slices():
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "part", "kind", "blk")]
            at = 0
            for i in range(1, batch.num_rows + 1):
                if i == batch.num_rows or any(k[i] != k[at] for k in keys):
                    yield tuple(int(k[at]) for k in keys), batch.slice(at, i - at)
                    at = i

    held = None
    for key, group in itertools.groupby(slices(), key=lambda s: s[0]):
        rows = pa.Table.from_batches([s[1] for s in group]).combine_chunks()
        if key[2] == 0:
            held = key[:2], rows
        elif held and held[0] == key[:2]:
            yield held[1], rows


def _best(scores, k: int):
    """The places of the k largest scores, highest first, earlier places first among equals."""
    import numpy as np

    if len(scores) > k:
        # the partition leaves out only what is below the k-th largest; ties at it stay
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        among = np.arange(len(scores))
    return among[np.argsort(-scores[among], kind="stable")[:k]]


def _mine(k: int, low: int, high: int, wide: bool, window: bool):
    dtype = object if wide else "int64"

    def run(batches):
        import decimal

        import numpy as np
        import pyarrow as pa

        score_type = pa.decimal128(38, 0) if wide else pa.int64()

        def out(values, kind):
            if kind is score_type and wide:
                values = [decimal.Decimal(int(x)) for x in values]
            return pa.array(values, kind)

        last = None
        for tile, block in _tiles(batches):
            if tile is not last:
                # rows in id order, so that ties fall to the smaller id
                order = np.argsort(tile.column("id").to_numpy(), kind="stable")
                last, tile_rows = tile, tile.take(pa.array(order))
                ids, labels = tile_rows.column("id").to_numpy(), tile_rows.column("label").to_numpy()
                v = np.ascontiguousarray(_ints(tile_rows.column("v").combine_chunks(), dtype).T)
            scores = strassen(_ints(block.column("v").combine_chunks(), dtype), v)
            anchors, own = block.column("anchor").to_numpy(), block.column("id").to_numpy()
            label = block.column("label").to_numpy()
            positives = block.column("positive").to_pylist() if window else [None] * len(own)
            found = [[], [], [], []]
            for i in range(len(own)):
                same = labels == label[i]
                allowed = np.flatnonzero((~same if window else same) & (ids != own[i]))
                s = scores[i, allowed]
                for place, positive in enumerate(positives[i] or [] if window else [None]):
                    if window:
                        p = int(positive)
                        among = np.flatnonzero((s >= -(-low * p // 100)) & (s <= high * p // 100))
                    else:
                        among = np.arange(len(s))
                    best = among[_best(s[among], k)]
                    found[0] += [int(anchors[i])] * len(best)
                    found[1] += [place + 1] * len(best)
                    found[2] += ids[allowed[best]].tolist()
                    found[3] += s[best].tolist()
            yield pa.RecordBatch.from_arrays(
                [out(x, t) for x, t in zip(found, (pa.int64(), pa.int32(), pa.int64(), score_type))],
                names=["anchor", "place", "id", "score"])
    return run


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 5, low: int = 80, high: int = 100,
         scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank (from 1), negative_id, positive_score, negative_score.

    ``anchors`` are rows of the same columns, a stated set; each of its ``positives`` best rows of the same
    label gets its ``k`` best rows of other labels within ``low`` to ``high`` hundredths of its own score.
    """
    spark = rows.sparkSession
    ship_package(spark)
    candidates = quantised(rows, scale, id_col, vec_col, label_col)
    asked = materialize(
        quantised(anchors, scale, id_col, vec_col, label_col).distinct()
        .withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n, dim, largest = candidates.agg(F.count("*"), F.max("dim"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    wide = bool(n) and dim * largest ** 2 >= 1 << 62
    # rows per tile and block shrink with the width, so that their cells stay bounded
    tiles = F.greatest(F.lit(1), F.ceil(F.col("dim") * F.lit(n / tile))).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("dim") * F.lit(asked.count() / block))).cast("int")
    parts = max(1, -(-n * (dim or 1) // tile))
    empty = F.lit(None)
    dealt = candidates.select(
        "id", "label", "v", "dim", F.pmod(F.xxhash64("id", "v"), tiles).cast("int").alias("part"),
        F.lit(0).alias("kind"), F.lit(0).alias("blk"), F.lit(-1).cast("long").alias("anchor"))
    score_type = "decimal(38,0)" if wide else "long"

    def meet(queries: DataFrame, window: bool) -> DataFrame:
        packed = queries.select(
            "id", "label", "v", "dim", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("part"),
            F.lit(1).alias("kind"), F.pmod(F.xxhash64("anchor"), blocks).cast("int").alias("blk"), "anchor", "positive")
        both = dealt.withColumn("positive", empty.cast(f"array<{score_type}>")).unionByName(packed)
        return (both.repartition(parts, "dim", "part").sortWithinPartitions("dim", "part", "kind", "blk")
                .mapInArrow(_mine(k if window else positives, low, high, wide, window),
                            f"anchor long, place int, id long, score {score_type}"))

    def merged(heaps: DataFrame, keys: list[str], most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
        return heaps.withColumn("rank", rank).where(F.col("rank") <= most)

    first = materialize(merged(meet(asked.withColumn("positive", empty.cast(f"array<{score_type}>")), False),
                               ["anchor"], positives), "positives")
    listed = first.groupBy("anchor").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("positive"))
    second = merged(meet(asked.join(listed, "anchor"), True), ["anchor", "place"], k)
    chosen = first.select(F.col("anchor").alias("a"), F.col("rank").alias("positive_rank"),
                          F.col("id").alias("positive_id"), F.col("score").alias("ps"))
    named = asked.select(F.col("anchor").alias("b"), F.col("id").alias("anchor_id"))

    def as_long(c):
        return F.least(F.greatest(F.col(c), F.lit(-2 ** 63)), F.lit(2 ** 63 - 1)).cast("long")

    return (second.join(chosen, (F.col("anchor") == F.col("a")) & (F.col("place") == F.col("positive_rank")))
            .join(named, F.col("anchor") == F.col("b"))
            .select("anchor_id", "positive_id", "positive_rank", "rank", F.col("id").alias("negative_id"),
                    as_long("ps").alias("positive_score"), as_long("score").alias("negative_score")))

"""Exact top-k inner-product search on an impact-ordered, score-at-a-time index (operator 2).

Components are quantised to integers (``floor(scale * x)``).  The vectors are dealt into shards of about
``SHARD`` rows; a shard's index holds, for each dimension, its rows ordered by component, so that for a
query component of either sign the rows of highest impact form one end of the list.  With ``impact`` the
distance of a component from the worst end of its dimension, the score is a constant of the query plus the
sum of ``|q_d| * impact_d``, every term of which is at least 0.

A query lowers a threshold tau in steps.  Each step takes from every dimension the posting segment whose
impacts score at least tau, highest first, and adds exact scores to accumulators; a row that is still
unseen in u dimensions can gain less than ``u * tau``.  The query stops when the rows whose upper bound
reaches the k-th best lower bound are few (or everything is read), and scores exactly these rows.  No row
is left out without that proof, so the result is exact.

Queries are a stated set; they travel in blocks of ``BLOCK`` and every block meets every shard once.

Defined results: vectors that are null, empty or hold null, NaN or infinite components take no part, nor do
rows with a null id; a query is compared with vectors of its own width only; its own id is never a result;
a repeated row counts as often as it occurs; ties go to the smaller id; an empty table gives an empty result.
A component beyond 2**57 after scaling counts as 2**57; where the largest component and width do not prove that
all sums fit 64 bits, every row of a shard is scored by unbounded integers instead, and a score beyond a long is
given as the nearest long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package

#: Rows of a shard and queries of a block; both bound what one task holds.
SHARD, BLOCK = 16_384, 256
#: Components beyond this count as this.
LARGEST = 1 << 57
#: Steps of tau, as fractions of the largest term that a query has in a shard.
STEPS = (0.4, 0.22, 0.12, 0.06, 0.0)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id, v (array of long), dim; only the rows that can take part."""
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                           F.transform(F.col(vec_col), lambda c: c.cast("double")).alias("x"))
            .where(F.col("vec_id").isNotNull() & (F.size("x") > 0)
                   & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
            .select("vec_id", F.transform("x", lambda c: F.least(F.greatest(
                F.floor(c * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("long")).alias("v"), F.size("x").alias("dim")))


def _packed(with_index: bool, kind: int):
    """Pandas function: the rows of a shard or of a block as one row of little-endian int64 arrays."""
    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("vec_id", kind="stable")
        v = np.stack(pdf["v"].to_numpy()).astype("<i8")
        order = np.argsort(v, axis=0, kind="stable").T.astype("<i4") if with_index else np.zeros(0, "<i4")
        return pd.DataFrame({"dim": [v.shape[1]], "part": [int(pdf["part"].iloc[0])], "kind": [kind],
                             "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "v": [v.tobytes()],
                             "ord": [np.ascontiguousarray(order).tobytes()]})
    return run


PACKED = "dim int, part long, kind int, ids binary, v binary, ord binary"


class Shard:
    """The index of one shard: rows in id order, and per dimension the rows ordered by component."""

    def __init__(self, ids, v, order):
        import numpy as np

        self.ids, self.v, self.order = ids, v, np.ascontiguousarray(order, np.intp)
        self.ordered = np.ascontiguousarray(np.take_along_axis(v.T, self.order, axis=1))
        self.low, self.high = self.ordered[:, 0], self.ordered[:, -1]
        self.largest = int(np.abs(v).max(initial=0))
        self.exact = v.astype(np.float64)

    def top(self, own: int, q, k: int, stats: list | None = None):
        """The k best (score, id) of the shard's rows other than ``own``; ties to the smaller id."""
        import numpy as np

        n, dim = self.v.shape
        weight = np.abs(q)
        reach = weight * (self.high - self.low)
        active = np.flatnonzero(reach)
        # an accumulator holds the exact score so far and, above it, the number of dimensions seen; where the
        # score may not fit below, the number has an array of its own
        held = np.zeros(n, np.int64)
        one = 1 << 44
        seen = np.zeros(n, np.int64) if int(reach.sum()) >= one or dim >= 1 << 18 else None
        mine = np.flatnonzero(self.ids == own)
        done, unread, among = [0] * dim, n * len(active), np.arange(n)
        for step in STEPS:
            tau = int(reach.max(initial=0) * step)
            if not unread or not tau and step:
                continue
            for d in active:
                # impacts of at least tau / weight, highest first; these rows form one end of the list
                least = -(-tau // int(weight[d]))
                if q[d] > 0:
                    to = n - int(np.searchsorted(self.ordered[d], self.low[d] + least, "left"))
                    rows, impacts = slice(n - to, n - done[d]), self.ordered[d, n - to:n - done[d]] - self.low[d]
                else:
                    to = int(np.searchsorted(self.ordered[d], self.high[d] - least, "right"))
                    rows, impacts = slice(done[d], to), self.high[d] - self.ordered[d, done[d]:to]
                if to > done[d]:
                    if seen is None:
                        held[self.order[d, rows]] += impacts * weight[d] + one
                    else:
                        held[self.order[d, rows]] += impacts * weight[d]
                        seen[self.order[d, rows]] += 1
                    unread -= to - done[d]
                    done[d] = to
            gained, known = (held & (one - 1), held >> 44) if seen is None else (held, seen)
            lower = gained.copy()
            lower[mine] = -1
            if n - len(mine) > k:
                kth = np.partition(lower, n - k)[n - k]
                among = np.flatnonzero(gained + (len(active) - known) * max(tau - 1, 0) >= kth)
            # the rows left are scored once scoring them costs no more than reading on
            if len(among) * dim <= max(unread, k * dim):
                break
        among = among[self.ids[among] != own]
        if stats is not None:
            stats.append((n, len(among), unread))
        if self.largest * int(weight.max(initial=0)) * dim < 2 ** 53:
            scores = (self.exact[among] @ q.astype(np.float64)).astype(np.int64)
        else:
            scores = self.v[among] @ q
        best = np.lexsort((self.ids[among], -scores))[:k]
        return scores[best], self.ids[among][best]


def _wide_top(ids, v, own: int, q, k: int):
    """The k best (score, id) by unbounded integers."""
    rows = [i for i, x in enumerate(ids) if x != own]
    scores = (v[rows].astype(object) @ q.astype(object)).tolist() if rows else []
    best = sorted((-s, int(ids[i])) for s, i in zip(scores, rows))[:k]
    return [-s for s, _ in best], [i for _, i in best]


def _search(k: int, wide: bool):
    def run(batches):
        import decimal

        import numpy as np
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.decimal128(38, 0) if wide else pa.int64()]

        shard = None
        for batch in batches:
            found = [[], [], []]
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                v = np.frombuffer(row["v"], "<i8").reshape(len(ids), row["dim"])
                if row["kind"] == 0:
                    shard = (row["dim"], row["part"], (ids, v) if wide else
                             Shard(ids, v, np.frombuffer(row["ord"], "<i4").reshape(row["dim"], len(ids))))
                elif shard and shard[:2] == (row["dim"], row["part"]):
                    for own, q in zip(ids, v):
                        if wide:
                            scores, best = _wide_top(*shard[2], own, q, k)
                            scores = [decimal.Decimal(s) for s in scores]
                        else:
                            scores, best = (x.tolist() for x in shard[2].top(own, q, k))
                        found[0] += [int(own)] * len(best)
                        found[1] += best
                        found[2] += scores
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds)],
                                             names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vec_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row of ``queries`` the ``k`` best rows of ``vectors``."""
    ship_package(vectors.sparkSession)
    rows, asked = quantised(vectors, id_col, vec_col, scale), quantised(queries, id_col, vec_col, scale).distinct()
    n, dim, largest = rows.agg(F.count("*"), F.max("dim"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    most = asked.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    wide = bool(n) and dim * max(largest, most or 0) ** 2 >= 1 << 60
    parts = max(1, -(-n // shard))
    blocks = max(1, -(-asked.count() // block))
    index = (rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)))
             .groupBy("dim", "part").applyInPandas(_packed(True, 0), PACKED))
    packed = (asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
              .groupBy("dim", "part").applyInPandas(_packed(False, 1), PACKED)
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))))
    # each task reads a shard's index once and streams every block of queries past it
    met = (index.unionByName(packed).repartition(parts, "dim", "part").sortWithinPartitions("dim", "part", "kind")
           .mapInArrow(_search(k, wide), f"query_id long, vec_id long, score {'decimal(38,0)' if wide else 'long'}"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    score = F.least(F.greatest(F.col("score"), F.lit(-2 ** 63)), F.lit(2 ** 63 - 1)).cast("long").alias("score")
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)

"""Dense per-group ordinals without putting a whole group into one task.

``row_number() over (partition by repo order by ...)`` sends every row of a repository
to one task, and one repository may hold a third of the corpus.  Instead the rows
are range-partitioned on ``(group, order)`` with an explicit partition count (Spark
samples the key distribution, so a hot group is spread over many partitions, and
AQE never coalesces an explicit-count repartition), sorted inside each partition,
and numbered by ``monotonically_increasing_id`` in that order.  The dealt rows, with
partition number and position, are written once to the shared folder: both users of
them read the same partitioning (planned twice, the two range exchanges would sample
and cut on their own).  A small table of per-(partition, group) first ids and counts —
each group's rows bounded by the partition count — supplies the offsets of earlier
partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin an under-partitioned input (e.g. one large row group) over the cores.

    At cluster scale inputs already have thousands of splits and this is a no-op;
    it only adds a shuffle when the input has fewer partitions than cores.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def group_ordinals(df: DataFrame, group: list[str], order: list[str], out: str = "ordinal",
                   partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of the row inside its group in ``order``.

    Equal to ``row_number() over (partition by group order by order) - 1``;
    ``order`` must be unique within a group.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group + order]
    ranged = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mono", F.monotonically_increasing_id()), "ordinals")
    firsts = ranged.groupBy("_pid", *group).agg(F.min("_mono").alias("_first"),
                                                F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = firsts.select("_pid", *group, "_first",
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return (ranged.join(offsets, ["_pid", *group])
            .withColumn(out, (F.col("_off") + F.col("_mono") - F.col("_first")).cast("bigint"))
            .drop("_pid", "_mono", "_first", "_off"))


#: Rows and bytes of a thin table that may be broadcast; besides its keys a row of the hash table takes so many bytes,
#: which the driver and every executor hold.
BROADCAST_ROWS, BROADCAST_BYTES, ROW_BYTES = 1_000_000, 64 << 20, 150


def running_totals(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come earlier in ``order``.

    The table is written range-sorted once; sums inside a partition are a window over it, and one row per
    (partition, group) carries the sums of earlier partitions, so no group meets in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group + order]
    ranged = materialize(df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()), "running-totals")
    inside = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = (ranged.groupBy("_pid", *group).agg(F.sum(value).alias("_sum"))
             .select("_pid", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")))
    return (ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(parts, ["_pid", *group])
            .withColumn(out, F.col("_before") + F.col("_in")).drop("_pid", "_in", "_before"))


def travelling(thin: DataFrame, on: list[str]) -> DataFrame:
    """``thin``, written and measured: to be broadcast by joins on ``on`` if within the bounds, else shuffled by them."""
    thin = materialize(thin, "thin")
    n, size = thin.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((F.octet_length(c) for c in on), F.lit(ROW_BYTES))), F.lit(0))).first()
    return F.broadcast(thin) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else thin

"""Connected components of an edge table, in rounds of small jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every id in ``edges`` (a, b) the smallest id it is connected with.

    Alternates large-star and small-star steps (each links a node's neighbours to its smallest neighbour), which
    halves the depth of every tree per pair of steps; the state between steps is a table in the shared folder.
    A hub's neighbours are only ever joined with the hub's minimum, never with each other.
    """
    state = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), "edges")
    while True:
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.withColumnRenamed("m", "v")).distinct())
        after = materialize(small, "edges")
        # done when every node points straight at a root
        deep = after.select("v").distinct().join(after.select(F.col("u").alias("v")), "v", "left_semi")
        split = after.groupBy("u").count().where("count > 1")
        state = after
        if deep.isEmpty() and split.isEmpty():
            break
    roots = state.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)

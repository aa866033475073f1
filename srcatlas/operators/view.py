"""Graph display tables (J7, J8, F4-F7): the reference's interactive page as data.

Two left joins attach degree and cycle flag to nodes; the cycle-node set is joined
on ``(repo, node)`` (AQE broadcasts it when it is measured small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name

# Fixed display values.
LANGUAGE_COLOURS = {"python": "#4B8BBE", "javascript": "#F7DF1E", "typescript": "#3178C6", "default": "#888780"}
CYCLE_COLOUR = "#E24B4A"
EDGE_COLOUR = "#555577"
EDGE_WIDTH = 1.5
SIZE_BASE, SIZE_PER_EDGE, SIZE_CAP = 15, 5, 50
CYCLE_NOTE = "⚠️ Part of circular dependency"


def node_size(in_degree) -> Column:
    """``min(15 + 5 * in_degree, 50)``."""
    d = F.col(in_degree) if isinstance(in_degree, str) else in_degree
    return F.least(F.lit(SIZE_BASE) + F.lit(SIZE_PER_EDGE) * d, F.lit(SIZE_CAP))


def node_view(nodes: DataFrame, edges: DataFrame, cycle_nodes: DataFrame) -> DataFrame:
    """J7 + F4-F6: ``node, label, title, color, size`` per node."""
    ind = edges.groupBy("repo_name", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    cyc = cycle_nodes.select("repo_name", "node").distinct().withColumn("in_cycle", F.lit(True))
    colours = F.create_map(*[F.lit(x) for kv in LANGUAGE_COLOURS.items() for x in kv])
    n = (nodes.join(ind, ["repo_name", "node"], "left").join(cyc, ["repo_name", "node"], "left")
         .select("repo_name", "node", F.coalesce("language", F.lit("default")).alias("language"),
                 F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
                 F.coalesce("in_cycle", F.lit(False)).alias("in_cycle")))
    return n.select(
        "repo_name", "node", file_name("node").alias("label"),
        F.concat(F.lit("<b>"), "node", F.lit("</b><br>Language: "), "language", F.lit("<br>Imported by: "),
                 F.col("in_degree").cast("string"), F.lit(" file(s)<br>"),
                 F.when(F.col("in_cycle"), F.lit(CYCLE_NOTE)).otherwise(F.lit(""))).alias("title"),
        F.when(F.col("in_cycle"), F.lit(CYCLE_COLOUR))
        .otherwise(F.coalesce(F.try_element_at(colours, F.col("language")), F.lit(LANGUAGE_COLOURS["default"])))
        .alias("color"),
        node_size("in_degree").alias("size"), "in_degree", "in_cycle")


def edge_view(edges: DataFrame, cycle_nodes: DataFrame) -> DataFrame:
    """J8 + F7: red when both endpoints are cycle nodes (also between two cycles)."""
    cyc = cycle_nodes.select("repo_name", "node").distinct()
    e = (edges.join(cyc.select("repo_name", F.col("node").alias("src"), F.lit(True).alias("_s")), ["repo_name", "src"], "left")
         .join(cyc.select("repo_name", F.col("node").alias("dst"), F.lit(True).alias("_d")), ["repo_name", "dst"], "left"))
    flag = F.coalesce("_s", F.lit(False)) & F.coalesce("_d", F.lit(False))
    return e.select("repo_name", "src", "dst", flag.alias("in_cycle"),
                    F.when(flag, F.lit(CYCLE_COLOUR)).otherwise(F.lit(EDGE_COLOUR)).alias("color"),
                    F.lit(EDGE_WIDTH).alias("width"), F.lit("to").alias("arrows"))

"""Dependency graph tables and analytics.

Nodes are the selected files; edges are resolved imports without self-edges,
duplicates collapsed.  Every per-repository top-n is ``row_number() <= n`` (planned as
``WindowGroupLimit``, so a huge repository ships only n rows per task).  Order
follows the reference: nodes in file order (code-point ``rel_path`` here), edges by
source then first discovery of the import, ties of stable descending sorts kept
in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordinals import group_ordinals


def graph_nodes(files: DataFrame) -> DataFrame:
    """Every selected file is a node (isolated ones too)."""
    return files.select("repo_name", F.col("rel_path").alias("node"), "language", "size")


def graph_edges(resolved: DataFrame, imports: DataFrame) -> DataFrame:
    """``repo_name, src, dst, weight, first_ord`` (first discovery of the import)."""
    ords = imports.groupBy("repo_name", "src", "import_path").agg(F.min("import_ord").alias("o"))
    return (resolved.filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
            .join(ords, ["repo_name", "src", "import_path"])
            .groupBy("repo_name", "src", "dst").agg(F.min("o").alias("first_ord"))
            .withColumn("weight", F.lit(1)))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree per node, zeros included.

    Both ends of every edge are counted in one aggregation (one shuffle of the edges,
    partial aggregation before it, so a file imported by everybody stays cheap) and
    attached to the nodes with one join.
    """
    ends = edges.select("repo_name", F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    d = ends.groupBy("repo_name", F.col("x.node").alias("node")).agg(
        F.sum("x.i").cast("bigint").alias("in_degree"), F.sum("x.o").cast("bigint").alias("out_degree"))
    return nodes.join(d, ["repo_name", "node"], "left").fillna(0, ["in_degree", "out_degree"])


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: node and edge counts per repository (edge-less graphs give 0)."""
    n = nodes.groupBy("repo_name").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("repo_name").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, "repo_name", "full_outer").fillna(0, ["nodes", "edges"])


def _top(df: DataFrame, n: int, *order) -> DataFrame:
    w = Window.partitionBy("repo_name").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def most_depended_on(deg: DataFrame, n: int = 5, positive: bool = True) -> DataFrame:
    """K1 (n=5, in-degree > 0) / K2 (n=10, zeros allowed): ``rank, file, imported_by``."""
    d = deg.filter(F.col("in_degree") > 0) if positive else deg
    return _top(d, n, F.col("in_degree").desc(), "node").select(
        "repo_name", "rank", F.col("node").alias("file"), F.col("in_degree").alias("imported_by"))


def top_out_degree(deg: DataFrame, n: int = 10) -> DataFrame:
    """K3: ``rank, file, imports`` by out-degree."""
    return _top(deg, n, F.col("out_degree").desc(), "node").select(
        "repo_name", "rank", F.col("node").alias("file"), F.col("out_degree").alias("imports"))


def top_edges(edges: DataFrame, deg: DataFrame, n: int = 50) -> DataFrame:
    """K4: edges by (in-degree of target, out-degree of source), descending, stable."""
    d = deg.select("repo_name", "node", "in_degree", "out_degree")
    e = (edges.join(d.select("repo_name", F.col("node").alias("dst"), F.col("in_degree").alias("dst_in")),
                    ["repo_name", "dst"])
         .join(d.select("repo_name", F.col("node").alias("src"), F.col("out_degree").alias("src_out")),
               ["repo_name", "src"]))
    return _top(e, n, F.col("dst_in").desc(), F.col("src_out").desc(), "src", "first_ord").select(
        "repo_name", "rank", "src", "dst", "dst_in", "src_out")


def entry_points(deg: DataFrame, n: int = 10) -> DataFrame:
    """In-degree 0, first n in node order."""
    return _top(deg.filter(F.col("in_degree") == 0), n, "node").select("repo_name", "rank", "node")


def _ordered_list(df: DataFrame, value) -> DataFrame:
    """Per repo, ``value`` strings in ``rank`` order (bounded lists: ranks are capped)."""
    return df.groupBy("repo_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda x: x["v"]).alias("l"))


def architecture_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per repository with the four display lists and the two counts."""
    deg = degrees(nodes, edges)
    ep = _ordered_list(entry_points(deg, 10), F.col("node")).withColumnRenamed("l", "entry_points")
    md = _ordered_list(most_depended_on(deg, 10, positive=False),
                       F.format_string("%s (%d imports)", "file", "imported_by")).withColumnRenamed("l", "most_depended_on")
    lm = _ordered_list(top_out_degree(deg, 10),
                       F.format_string("%s (%d outgoing deps)", "file", "imports")).withColumnRenamed("l", "largest_modules")
    te = _ordered_list(top_edges(edges, deg, 50),
                       F.concat_ws(" -> ", "src", "dst")).withColumnRenamed("l", "dependencies")
    size = graph_size(nodes, edges).withColumnRenamed("nodes", "node_count").withColumnRenamed("edges", "edge_count")
    empty = F.array().cast("array<string>")
    out = size
    for part, name in ((ep, "entry_points"), (md, "most_depended_on"), (lm, "largest_modules"),
                       (te, "dependencies")):
        out = out.join(part, "repo_name", "left").withColumn(name, F.coalesce(name, empty))
    return out.select("repo_name", "entry_points", "most_depended_on", "largest_modules", "dependencies",
                      "node_count", "edge_count")


def pack_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo_name, graph_data struct<nodes, edges>``, a row per repository; attributes are dropped.

    One row holds a repository's whole graph, which is the reference's stored form and as large as the
    repository; the jobs store ``graph_blocks``, which are not.
    """
    n = nodes.groupBy("repo_name").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    e = edges.groupBy("repo_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("src", "first_ord", "dst"))),
                    lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"))).alias("edges"))
    return (n.join(e, "repo_name", "full_outer")
            .select("repo_name", F.struct(
                F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"),
                F.coalesce("edges", F.array().cast("array<struct<src:string,dst:string>>")).alias("edges"))
                .alias("graph_data")))


#: Nodes of a block.
BLOCK_NODES = 4096


def graph_blocks(nodes: DataFrame, edges: DataFrame, block: int = BLOCK_NODES) -> DataFrame:
    """S10 for graphs of any size: ``repo_name, block, nodes, targets``, a row per ``block`` consecutive nodes.

    Nodes are numbered in code-point order through the repository, ``block * size`` being the first of a block;
    ``targets`` has a list per node, the numbers of the files it imports in discovery order, each less the
    node's own number.  A row holds at most ``block`` nodes and their imports.  Edges from or to files that are
    no nodes are left out.
    """
    numbered = materialize(group_ordinals(nodes.select("repo_name", "node").distinct(), ["repo_name"], ["node"], "ord"), "node-numbers")
    ends = (edges.join(numbered.select("repo_name", F.col("node").alias("src"), F.col("ord").alias("s")), ["repo_name", "src"])
            .join(numbered.select("repo_name", F.col("node").alias("dst"), F.col("ord").alias("d")), ["repo_name", "dst"]))
    lists = ends.groupBy("repo_name", F.col("s").alias("ord")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("first_ord", "d"))), lambda x: x["d"]).alias("l"))
    one = numbered.join(lists, ["repo_name", "ord"], "left").select(
        "repo_name", F.floor(F.col("ord") / block).alias("block"), "ord", "node",
        F.transform(F.coalesce("l", F.array().cast("array<bigint>")), lambda d: d - F.col("ord")).alias("l"))
    rows = F.array_sort(F.collect_list(F.struct("ord", "node", "l")))
    return (one.groupBy("repo_name", "block").agg(rows.alias("r"))
            .select("repo_name", "block", F.transform("r", lambda x: x["node"]).alias("nodes"),
                    F.transform("r", lambda x: x["l"]).alias("targets")))


def from_blocks(blocks: DataFrame, block: int = BLOCK_NODES) -> tuple[DataFrame, DataFrame]:
    """S11 for ``graph_blocks``: (nodes, edges); ``first_ord`` counts the imports of a file, the language is ``default``."""
    one = (blocks.select("repo_name", "block", F.posexplode(F.arrays_zip("nodes", "targets")).alias("i", "x"))
           .select("repo_name", (F.col("block") * block + F.col("i")).alias("ord"), F.col("x.nodes").alias("node"), F.col("x.targets").alias("l")))
    nodes = one.select("repo_name", "node", F.lit("default").alias("language"), F.lit(None).cast("bigint").alias("size"))
    edges = (one.select("repo_name", F.col("node").alias("src"), "ord", F.posexplode("l").alias("place", "delta"))
             .select("repo_name", "src", (F.col("ord") + F.col("delta")).alias("ord"), F.col("place").cast("bigint").alias("first_ord"))
             .join(one.select("repo_name", "ord", F.col("node").alias("dst")), ["repo_name", "ord"])
             .select("repo_name", "src", "dst", "first_ord", F.lit(1).alias("weight")))
    return nodes, edges


def unpack_graph(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inverse of S10; edge endpoints missing from the node list are added with
    default attributes (language ``default``), as the graph library would."""
    listed = packed.select("repo_name", F.posexplode_outer("graph_data.nodes").alias("node_ord", "node")) \
        .filter(F.col("node").isNotNull())
    edges = packed.select("repo_name", F.posexplode_outer("graph_data.edges").alias("edge_ord", "e")) \
        .filter(F.col("e").isNotNull()) \
        .select("repo_name", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"),
                F.col("edge_ord").cast("bigint").alias("first_ord"), F.lit(1).alias("weight"))
    ends = edges.select("repo_name", F.col("src").alias("node")).union(edges.select("repo_name", F.col("dst").alias("node")))
    extra = ends.distinct().join(listed.select("repo_name", "node"), ["repo_name", "node"], "left_anti")
    nodes = (listed.select("repo_name", "node").unionByName(extra)
             .withColumn("language", F.lit("default")).withColumn("size", F.lit(None).cast("bigint")))
    return nodes, edges

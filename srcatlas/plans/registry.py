"""Registered queries (Spark side) and their DuckDB oracle SQL.

Every query reads the driver tables (or the code corpus Spark derives from
``documents``) and runs over them whole.  Column names and types are aligned with
the oracle: integers are BIGINT unless they are line numbers (INTEGER), doubles are
rounded where the two engines may differ in the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk, select
from ..sources.corpus import code_corpus
from . import sqlparts as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected source files of the derived corpus: a projection of ``documents``.

    Texts are not copied; the jobs write what they derive (imports, nodes, edges, chunks), each read from here
    by one pass over the columns it needs.
    """
    return select.select_sources(code_corpus(spark, sf_dir))


# --------------------------------------------------------------------------- selection
@register("selected_files", f"""
WITH {S.selected_cte()}
SELECT repo_name, rel_path, language, size FROM sel""")
def q_selected_files(spark, sf_dir):
    return selected(spark, sf_dir).select("repo_name", "rel_path", "language", "size")


@register("selection_audit", f"""
WITH {S.corpus_cte()}
SELECT repo_name, {S.reason_sql()} AS reason, count(*) AS n_files FROM code_corpus GROUP BY ALL""")
def q_selection_audit(spark, sf_dir):
    return select.selection_audit(code_corpus(spark, sf_dir))


@register("file_cap", f"""
WITH {S.selected_cte()}
SELECT repo_name, rel_path, language FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY rel_path) AS rn FROM sel) WHERE rn <= 500""")
def q_file_cap(spark, sf_dir):
    """The per-repo file cap at the reference's default of 500."""
    return select.select_sources(code_corpus(spark, sf_dir), max_files=500).select("repo_name", "rel_path", "language")


# --------------------------------------------------------------------------- chunking
LINE_CHUNKS_SQL = f"""
WITH {S.selected_cte()}, {S.lines_cte()},
g AS (SELECT repo_name, rel_path, language, ls, unnest(range(0, len(ls), 50)) AS g0 FROM split2),
c AS (SELECT repo_name, rel_path AS file_path, language, 'raw' AS chunk_type,
        array_to_string(ls[g0 + 1 : g0 + 50], chr(10)) AS text,
        CAST(g0 + 1 AS INTEGER) AS start_line, CAST(least(g0 + 50, len(ls)) AS INTEGER) AS end_line FROM g)
SELECT repo_name, file_path, language, chunk_type, text, start_line, end_line,
       concat('lines_', start_line, '_', end_line) AS name
FROM c WHERE length(text) >= 50"""


@register("line_chunks", LINE_CHUNKS_SQL)
def q_line_chunks(spark, sf_dir):
    return chunk.line_chunks(selected(spark, sf_dir))


@register("raw_chunk_ids", f"""
WITH lc AS ({LINE_CHUNKS_SQL})
SELECT repo_name, CAST(row_number() OVER (PARTITION BY repo_name ORDER BY file_path, start_line) - 1 AS BIGINT)
       AS chunk_id, file_path, start_line FROM lc""")
def q_raw_chunk_ids(spark, sf_dir):
    """C9 over 50-line chunks: dense ids per repository in file then line order."""
    return (chunk.chunk_files(selected(spark, sf_dir), definitions_enabled=False)
            .select("repo_name", "chunk_id", "file_path", "start_line"))


DEFS_SQL = f"""
WITH {S.selected_cte()}, {S.lines_cte()}, {S.definitions_cte()}"""

CHUNKS_SQL = f"""{DEFS_SQL},
lc AS ({LINE_CHUNKS_SQL.replace("WITH ", "SELECT * FROM (WITH ", 1)})),
with_defs AS (SELECT DISTINCT repo_name, file_path FROM defs),
chosen AS (SELECT repo_name, file_path, language, chunk_type, name, start_line, end_line, ord, text FROM defs UNION ALL
           SELECT repo_name, file_path, language, chunk_type, name, start_line, end_line, start_line, text FROM lc
           WHERE NOT EXISTS (SELECT 1 FROM with_defs w WHERE w.repo_name = lc.repo_name AND w.file_path = lc.file_path)),
chunks AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_name
             ORDER BY file_path, ord) - 1 AS BIGINT) AS chunk_id FROM chosen)"""


@register("definition_chunks", DEFS_SQL + """
SELECT repo_name, file_path, language, chunk_type, name, start_line, end_line, text FROM defs""")
def q_definition_chunks(spark, sf_dir):
    """Every definition chunk of every selected file."""
    from ..operators.definitions import definition_chunks
    return definition_chunks(selected(spark, sf_dir))


@register("chunks", CHUNKS_SQL + """
SELECT repo_name, chunk_id, file_path, chunk_type, name, start_line, end_line, language, text FROM chunks""")
def q_chunks(spark, sf_dir):
    """Definition chunks, else 50-line chunks, with dense ids per repository."""
    return chunk.chunk_files(selected(spark, sf_dir))


@register("chunk_counts", CHUNKS_SQL + """
SELECT repo_name, language, count(DISTINCT file_path) AS files, count(*) AS chunks,
       CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks GROUP BY ALL""")
def q_chunk_counts(spark, sf_dir):
    """G12 flagship: files and chunks per repository and language."""
    return (chunk.chunk_files(selected(spark, sf_dir))
            .groupBy("repo_name", "language")
            .agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"),
                 F.sum(F.length("text")).cast("bigint").alias("chars")))


# --------------------------------------------------------------------------- vectors
def embedding_index(spark, sf_dir):
    """Index rows from ``embeddings``: repository = label, chunk id = vec_id."""
    from ..sources.corpus import table
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("repo"), F.col("label").cast("string")).alias("repo_name"),
        F.col("vec_id").alias("chunk_id"), "embedding")


VEC_SQL = """
WITH v AS (SELECT vec_id, concat('repo', CAST(label AS VARCHAR)) AS repo_name,
                  CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, i.repo_name, i.vec_id AS chunk_id,
             list_dot_product(i.e, q.e) / (sqrt(list_dot_product(i.e, i.e)) * sqrt(list_dot_product(q.e, q.e))) AS raw
      FROM v q JOIN v i ON q.repo_name = i.repo_name)
SELECT query_id, repo_name, CAST(rank AS INTEGER) AS rank, chunk_id, round(raw, 4) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM p)
WHERE rank <= 5"""


@register("vector_search", VEC_SQL)
def q_vector_search(spark, sf_dir):
    """Every vector searches the top 5 of its own repository (label)."""
    from ..operators import vectors
    idx = embedding_index(spark, sf_dir)
    qs = idx.select(F.col("chunk_id").alias("query_id"), "repo_name", "embedding")
    return vectors.search(idx, qs, top_k=5).select("query_id", "repo_name", "rank", "chunk_id", "score")


def approx_parts(spark, sf_dir):
    """(index, queries, approximate hits) of every vector in its own repository; buckets of 16 rows."""
    from ..operators import vectors
    idx = embedding_index(spark, sf_dir)
    qs = idx.select(F.col("chunk_id").alias("query_id"), "repo_name", "embedding")
    return idx, qs, vectors.search_approx(idx, qs, top_k=5, tables=12, probes=4, bucket_rows=16)


@register("vector_search_approx")
def q_vector_search_approx(spark, sf_dir):
    """V3: bucketed candidates scored exactly (approximate: rows-only check; recall is checked next)."""
    return approx_parts(spark, sf_dir)[2].select("query_id", "repo_name", "rank", "chunk_id", "score")


@register("vector_search_recall", f"""
SELECT repo_name, count(DISTINCT query_id) AS queries, count(*) AS exact_hits, true AS recall_of_090 FROM ({VEC_SQL}) GROUP BY ALL""")
def q_vector_search_recall(spark, sf_dir):
    """V3 against V2: per repository the exact hits and whether nine tenths of them are found."""
    from ..operators import vectors
    idx, qs, approx = approx_parts(spark, sf_dir)
    return vectors.recall(approx, vectors.search(idx, qs, top_k=5)).select(
        "repo_name", "queries", "exact_hits", (F.col("recall") >= 0.9).alias("recall_of_090"))


@register("sample_chunks", CHUNKS_SQL + """
SELECT repo_name, chunk_id, file_path, chunk_type, name, start_line, end_line, language, text, 1.0 AS score
FROM chunks WHERE chunk_id < 15""")
def q_sample_chunks(spark, sf_dir):
    """The review sample, first 15 chunks by id per repository."""
    from ..operators import vectors
    return vectors.sample_chunks(chunk.chunk_files(selected(spark, sf_dir)), limit=15)


def requested_repos(spark, sf_dir):
    """Repositories asked about: derived from ``documents`` (repo5, repo6 have no files)."""
    from ..sources.corpus import table
    return (table(spark, sf_dir, "documents")
            .select(F.concat(F.lit("repo"), (F.col("doc_id") % 7).cast("string")).alias("repo_name")).distinct())


REQ_SQL = "req AS (SELECT DISTINCT concat('repo', CAST(doc_id % 7 AS VARCHAR)) AS repo_name FROM documents)"


@register("index_status", CHUNKS_SQL + f""", {REQ_SQL},
cnt AS (SELECT repo_name, count(*) AS n FROM chunks GROUP BY ALL)
SELECT req.repo_name, coalesce(n, 0) > 0 AS indexed, CAST(coalesce(n, 0) AS BIGINT) AS chunks
FROM req LEFT JOIN cnt USING (repo_name)""")
def q_index_status(spark, sf_dir):
    """Indexed flag and chunk count per requested repository."""
    from ..operators import vectors
    return vectors.index_status(chunk.chunk_files(selected(spark, sf_dir)), requested_repos(spark, sf_dir))


# --------------------------------------------------------------------------- graph
GRAPH_SQL = f"""
WITH {S.selected_cte()}, {S.graph_cte()}"""


def import_parts(spark, sf_dir):
    """(files, imports) of the code corpus, both thin and written once: several branches read them."""
    from ..operators import imports
    from ..session import materialize
    sources = selected(spark, sf_dir)
    return (materialize(sources.select("repo_name", "rel_path", "language", "size"), "files"),
            materialize(imports.extract_imports(sources), "imports"))


def graph_parts(spark, sf_dir):
    """(files, imports, resolved, nodes, edges) of the code corpus; files without their contents."""
    from ..operators import graph, imports
    from ..session import materialize
    files, imps = import_parts(spark, sf_dir)
    res = imports.resolve_imports(imps, files)
    return files, imps, res, graph.graph_nodes(files), materialize(graph.graph_edges(res, imps), "edges")


@register("imports", GRAPH_SQL + """
SELECT repo_name, src, language, import_path, import_ord FROM imports""")
def q_imports(spark, sf_dir):
    """I1 + I2: every import statement target in discovery order."""
    from ..operators import imports
    return imports.extract_imports(selected(spark, sf_dir))


@register("import_counts", GRAPH_SQL + """
SELECT repo_name, src, count(*) AS n_imports FROM imports GROUP BY ALL""")
def q_import_counts(spark, sf_dir):
    """Imports per file."""
    from ..operators import imports
    return imports.import_counts(imports.extract_imports(selected(spark, sf_dir)))


@register("resolved_imports", GRAPH_SQL + """
SELECT repo_name, src, import_path, dst FROM resolved""")
def q_resolved_imports(spark, sf_dir):
    """J1 + J2: unaligned suffix join (Python) and candidate join (JS/TS)."""
    from ..operators import imports
    files, imps = import_parts(spark, sf_dir)
    return imports.resolve_imports(imps, files)


@register("unresolved_imports", GRAPH_SQL + """
SELECT i.repo_name, i.src, i.language, i.import_path, i.import_ord,
       CASE WHEN i.language = 'python' THEN 'module' WHEN starts_with(i.import_path, '.') THEN 'relative'
            WHEN starts_with(i.import_path, '@/') THEN 'alias' ELSE 'package' END AS kind
FROM imports i WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.repo_name = i.repo_name AND r.src = i.src
                                 AND r.import_path = i.import_path)""")
def q_unresolved_imports(spark, sf_dir):
    """Import occurrences without a target file."""
    from ..operators import imports
    files, imps = import_parts(spark, sf_dir)
    return imports.unresolved_imports(imps, imports.resolve_imports(imps, files))


@register("graph_edges", GRAPH_SQL + """
SELECT repo_name, src, dst, weight FROM edges""")
def q_graph_edges(spark, sf_dir):
    """Distinct edges without self-edges, weight 1."""
    return graph_parts(spark, sf_dir)[4].select("repo_name", "src", "dst", "weight")


@register("degrees", GRAPH_SQL + """
SELECT repo_name, node, language, in_degree, out_degree FROM deg""")
def q_degrees(spark, sf_dir):
    """J5 + G2 + G3: every file with in- and out-degree."""
    from ..operators import graph
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    return graph.degrees(nodes, edges).select("repo_name", "node", "language", "in_degree", "out_degree")


@register("graph_size", GRAPH_SQL + """
SELECT n.repo_name, n.nodes, coalesce(e.edges, 0) AS edges
FROM (SELECT repo_name, count(*) AS nodes FROM nodes GROUP BY ALL) n
LEFT JOIN (SELECT repo_name, count(*) AS edges FROM edges GROUP BY ALL) e USING (repo_name)""")
def q_graph_size(spark, sf_dir):
    """G1: node and edge counts."""
    from ..operators import graph
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    return graph.graph_size(nodes, edges)


def _top_sql(n, filt, order, cols):
    return GRAPH_SQL + f"""
SELECT {cols} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo_name ORDER BY {order}) AS INTEGER) AS rank
                    FROM deg {filt}) WHERE rank <= {n}"""


@register("most_depended_on", _top_sql(5, "WHERE in_degree > 0", "in_degree DESC, node",
                                       "repo_name, rank, node AS file, in_degree AS imported_by"))
def q_most_depended_on(spark, sf_dir):
    """K1: top 5 files by in-degree (> 0)."""
    from ..operators import graph
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    return graph.most_depended_on(graph.degrees(nodes, edges), 5, True)


@register("top_in_degree", _top_sql(10, "", "in_degree DESC, node",
                                    "repo_name, rank, node AS file, in_degree AS imported_by"))
def q_top_in_degree(spark, sf_dir):
    """K2: top 10 files by in-degree (zeros allowed)."""
    from ..operators import graph
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    return graph.most_depended_on(graph.degrees(nodes, edges), 10, False)


@register("top_out_degree", _top_sql(10, "", "out_degree DESC, node",
                                     "repo_name, rank, node AS file, out_degree AS imports"))
def q_top_out_degree(spark, sf_dir):
    """K3: top 10 files by out-degree."""
    from ..operators import graph
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    return graph.top_out_degree(graph.degrees(nodes, edges), 10)


@register("entry_points", _top_sql(10, "WHERE in_degree = 0", "node", "repo_name, rank, node"))
def q_entry_points(spark, sf_dir):
    """First 10 files nobody imports."""
    from ..operators import graph
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    return graph.entry_points(graph.degrees(nodes, edges), 10)


TOP_EDGES_SQL = GRAPH_SQL + """,
te AS (SELECT e.repo_name, e.src, e.dst, e.first_ord, d1.in_degree AS dst_in, d2.out_degree AS src_out
       FROM edges e JOIN deg d1 ON d1.repo_name = e.repo_name AND d1.node = e.dst
       JOIN deg d2 ON d2.repo_name = e.repo_name AND d2.node = e.src)
SELECT repo_name, rank, src, dst, dst_in, src_out FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo_name ORDER BY dst_in DESC, src_out DESC, src, first_ord) AS INTEGER) AS rank
  FROM te) WHERE rank <= 50"""


@register("top_edges", TOP_EDGES_SQL)
def q_top_edges(spark, sf_dir):
    """K4: top 50 edges by (in-degree of target, out-degree of source)."""
    from ..operators import graph
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    return graph.top_edges(edges, graph.degrees(nodes, edges), 50)


REACH_SQL = GRAPH_SQL + """,
reach AS (SELECT * FROM (WITH RECURSIVE r(repo_name, a, b) AS (
            SELECT repo_name, src, dst FROM edges
            UNION SELECT r.repo_name, r.a, e.dst FROM r JOIN edges e ON e.repo_name = r.repo_name AND e.src = r.b)
          SELECT * FROM r)),
cyc_nodes AS (SELECT DISTINCT repo_name, a AS node FROM reach WHERE a = b)"""

PATHS_SQL = REACH_SQL + """,
ce AS (SELECT e.repo_name, e.src, e.dst FROM edges e
       JOIN reach r1 ON r1.repo_name = e.repo_name AND r1.a = e.dst AND r1.b = e.src),
paths AS (SELECT * FROM (WITH RECURSIVE p(repo_name, start, last, path, len) AS (
            SELECT repo_name, src, dst, [src, dst], 2 FROM ce WHERE dst > src
            UNION ALL SELECT p.repo_name, p.start, c.dst, list_append(p.path, c.dst), p.len + 1
            FROM p JOIN ce c ON c.repo_name = p.repo_name AND c.src = p.last
            WHERE c.dst > p.start AND NOT list_contains(p.path, c.dst))
          SELECT * FROM p)),
cyc AS (SELECT p.repo_name, p.path, CAST(p.len AS INTEGER) AS length FROM paths p
        JOIN ce c ON c.repo_name = p.repo_name AND c.src = p.last AND c.dst = p.start)"""


def cycle_inputs(spark, sf_dir):
    from ..operators import cycles
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    from ..session import materialize
    return nodes, edges, materialize(cycles.strongly_connected(edges), "scc")


@register("cycle_nodes", REACH_SQL + """
SELECT repo_name, node FROM cyc_nodes""")
def q_cycle_nodes(spark, sf_dir):
    """Files on some import cycle (non-trivial strongly connected components)."""
    return cycle_inputs(spark, sf_dir)[2].select("repo_name", "node")


@register("cycles", PATHS_SQL + """
SELECT repo_name, path, length, true AS complete FROM cyc""")
def q_cycles(spark, sf_dir):
    """Elementary cycles, each from its smallest file on, and whether the search was whole (its SQL has no budget)."""
    from ..operators import cycles
    _, edges, scc = cycle_inputs(spark, sf_dir)
    return cycles.cycles(edges, scc)


@register("cycle_listing", PATHS_SQL + """
SELECT repo_name, rank, cycle FROM (
  SELECT repo_name, CAST(row_number() OVER (PARTITION BY repo_name ORDER BY length, array_to_string(path, chr(1))) AS INTEGER) AS rank,
         array_to_string(path, ' → ') || ' → ' || path[1] AS cycle FROM cyc) WHERE rank <= 5""")
def q_cycle_listing(spark, sf_dir):
    """First 5 cycles per repository rendered ``a → b → a``, of any length."""
    from ..operators import cycles
    _, edges, scc = cycle_inputs(spark, sf_dir)
    return cycles.show_cycles(cycles.first_cycles(edges, scc, 5), 5)


@register("graph_stats", PATHS_SQL + """,
md AS (SELECT repo_name, list({'file': node, 'imported_by': in_degree} ORDER BY rank) AS l FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY in_degree DESC, node) AS rank
         FROM deg WHERE in_degree > 0) WHERE rank <= 5 GROUP BY ALL)
SELECT n.repo_name, n.c AS nodes, coalesce(e.c, 0) AS edges, coalesce(k.c, 0) AS cycles,
       true AS cycles_complete, coalesce(md.l, []) AS most_depended_on
FROM (SELECT repo_name, count(*) AS c FROM nodes GROUP BY ALL) n
LEFT JOIN (SELECT repo_name, count(*) AS c FROM edges GROUP BY ALL) e USING (repo_name)
LEFT JOIN (SELECT repo_name, count(*) AS c FROM cyc GROUP BY ALL) k USING (repo_name)
LEFT JOIN md USING (repo_name)""")
def q_graph_stats(spark, sf_dir):
    """Nodes, edges, cycles (with completeness) and the top-5 most depended on."""
    from ..plans import jobs
    nodes, edges, scc = cycle_inputs(spark, sf_dir)
    return jobs.graph_stats(nodes, edges, scc=scc)


@register("architecture_context", TOP_EDGES_SQL.split("SELECT repo_name, rank, src, dst, dst_in, src_out FROM (")[0] + """,
ep AS (SELECT repo_name, list(node ORDER BY rank) AS l FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY node) AS rank FROM deg WHERE in_degree = 0)
       WHERE rank <= 10 GROUP BY ALL),
md AS (SELECT repo_name, list(node || ' (' || in_degree || ' imports)' ORDER BY rank) AS l FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY in_degree DESC, node) AS rank FROM deg)
       WHERE rank <= 10 GROUP BY ALL),
lm AS (SELECT repo_name, list(node || ' (' || out_degree || ' outgoing deps)' ORDER BY rank) AS l FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY out_degree DESC, node) AS rank FROM deg)
       WHERE rank <= 10 GROUP BY ALL),
dp AS (SELECT repo_name, list(src || ' -> ' || dst ORDER BY rank) AS l FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY dst_in DESC, src_out DESC, src, first_ord) AS rank FROM te)
       WHERE rank <= 50 GROUP BY ALL),
sz AS (SELECT n.repo_name, n.c AS node_count, coalesce(e.c, 0) AS edge_count
       FROM (SELECT repo_name, count(*) AS c FROM nodes GROUP BY ALL) n
       LEFT JOIN (SELECT repo_name, count(*) AS c FROM edges GROUP BY ALL) e USING (repo_name))
SELECT sz.repo_name, coalesce(ep.l, []) AS entry_points, coalesce(md.l, []) AS most_depended_on,
       coalesce(lm.l, []) AS largest_modules, coalesce(dp.l, []) AS dependencies, node_count, edge_count
FROM sz LEFT JOIN ep USING (repo_name) LEFT JOIN md USING (repo_name) LEFT JOIN lm USING (repo_name)
LEFT JOIN dp USING (repo_name)""")
def q_architecture_context(spark, sf_dir):
    """The architecture context bundle with its display strings."""
    from ..operators import graph
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    return graph.architecture_context(nodes, edges)


@register("graph_data", GRAPH_SQL + """,
pn AS (SELECT repo_name, list(node ORDER BY node) AS nodes FROM nodes GROUP BY ALL),
pe AS (SELECT repo_name, list({'src': src, 'dst': dst} ORDER BY src, first_ord, dst) AS edges FROM edges GROUP BY ALL)
SELECT pn.repo_name, {'nodes': pn.nodes, 'edges': coalesce(pe.edges, [])} AS graph_data
FROM pn LEFT JOIN pe USING (repo_name)""")
def q_graph_data(spark, sf_dir):
    """Node list + edge pair list per repository (attributes dropped)."""
    from ..operators import graph
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    return graph.pack_graph(nodes, edges)

# --------------------------------------------------------------------------- ranking and prompts
def _score_sql(path="rel_path"):
    from ..operators.rank import KEYWORDS, NEGATIVE_NAMES, PRIORITY_NAMES
    name = f"lower(regexp_extract({path}, '[^/]*$', 0))"
    q = lambda xs: ", ".join("'" + x + "'" for x in xs)
    kws = " + ".join(f"(CASE WHEN contains(lower({path}), '{k}') THEN 20 ELSE 0 END)" for k in KEYWORDS)
    return (f"((CASE WHEN {name} IN ({q(PRIORITY_NAMES)}) THEN 100 ELSE 0 END) + {kws}"
            f" + (CASE WHEN contains({name}, 'config') THEN 15 ELSE 0 END)"
            f" + (CASE WHEN {name} IN ({q(NEGATIVE_NAMES)}) THEN -100 ELSE 0 END))")


def _sql_str(text):
    return "'" + text.replace("'", "''") + "'"


@register("file_scores", f"""
WITH {S.selected_cte()}
SELECT repo_name, rel_path, CAST({_score_sql()} AS INTEGER) AS score FROM sel""")
def q_file_scores(spark, sf_dir):
    """F1: architectural relevance score of every selected file."""
    from ..operators.rank import file_score
    return selected(spark, sf_dir).select("repo_name", "rel_path", file_score("rel_path").cast("int").alias("score"))


BEST_SQL = CHUNKS_SQL + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, file_path
                                  ORDER BY length(text) DESC, chunk_id) AS r FROM chunks) WHERE r = 1),
firsts AS (SELECT repo_name, file_path, min(chunk_id) AS first_id FROM chunks GROUP BY ALL)"""


@register("best_chunk_per_file", BEST_SQL + """
SELECT repo_name, file_path, chunk_id FROM best""")
def q_best_chunk_per_file(spark, sf_dir):
    """Longest chunk of each file (first on ties)."""
    from ..operators import rank
    return rank.best_chunk_per_file(chunk.chunk_files(selected(spark, sf_dir))).select("repo_name", "file_path", "chunk_id")


ARCH_SQL = BEST_SQL + f""",
arch AS (SELECT * FROM (SELECT b.repo_name, b.file_path, b.chunk_id, CAST({_score_sql("b.file_path")} AS INTEGER) AS score,
                CAST(row_number() OVER (PARTITION BY b.repo_name ORDER BY {_score_sql("b.file_path")} DESC, f.first_id) AS INTEGER) AS rank
         FROM best b JOIN firsts f USING (repo_name, file_path)) WHERE rank <= 12)"""


@register("architecture_chunks", ARCH_SQL + """
SELECT repo_name, rank, file_path, chunk_id, score FROM arch""")
def q_architecture_chunks(spark, sf_dir):
    """K5: best chunk of the 12 most relevant files per repository."""
    from ..operators import rank
    return (rank.select_architecture_chunks(chunk.chunk_files(selected(spark, sf_dir)), 12)
            .select("repo_name", "rank", "file_path", "chunk_id", F.col("score").cast("int").alias("score")))


@register("file_listing", ARCH_SQL + """
SELECT repo_name, array_to_string(list_sort(list(DISTINCT file_path)), chr(10)) AS repo_structure FROM arch GROUP BY ALL""")
def q_file_listing(spark, sf_dir):
    """Sorted distinct files of the architecture chunks, newline-joined."""
    from ..operators import rank
    return rank.file_listing(rank.select_architecture_chunks(chunk.chunk_files(selected(spark, sf_dir)), 12))


def _review_sql():
    from ..operators.prompt import REVIEW_HEAD, REVIEW_TAIL
    return CHUNKS_SQL + f""",
blocks AS (SELECT repo_name, chunk_id, '--- File: ' || file_path || ' | ' || upper(substr(chunk_type, 1, 1))
             || lower(substr(chunk_type, 2)) || ': ' || name || ' | Lines: ' || start_line || '-' || end_line
             || ' ---' || chr(10) || text AS b FROM chunks WHERE chunk_id < 15)
SELECT repo_name, 'review' AS task,
       {_sql_str(REVIEW_HEAD)} || string_agg(b, chr(10) || chr(10) ORDER BY chunk_id) || {_sql_str(REVIEW_TAIL)} AS prompt,
       CAST(0.1 AS DOUBLE) AS temperature FROM blocks GROUP BY ALL"""


@register("review_prompts", _review_sql())
def q_review_prompts(spark, sf_dir):
    """T2 (+F2, F3, S6): the defect-review prompt of each repository."""
    from ..operators import prompt, vectors
    sample = vectors.sample_chunks(chunk.chunk_files(selected(spark, sf_dir)), 15)
    return prompt.review_prompts(sample)

# --------------------------------------------------------------------------- views, admission, more prompts
@register("node_view", REACH_SQL + """,
nv AS (SELECT d.repo_name, d.node, d.language, d.in_degree, c.node IS NOT NULL AS in_cycle
       FROM deg d LEFT JOIN cyc_nodes c ON c.repo_name = d.repo_name AND c.node = d.node)
SELECT repo_name, node, regexp_extract(node, '[^/]*$', 0) AS label,
       '<b>' || node || '</b><br>Language: ' || language || '<br>Imported by: ' || in_degree || ' file(s)<br>'
         || CASE WHEN in_cycle THEN '⚠️ Part of circular dependency' ELSE '' END AS title,
       CASE WHEN in_cycle THEN '#E24B4A' WHEN language = 'python' THEN '#4B8BBE'
            WHEN language = 'javascript' THEN '#F7DF1E' WHEN language = 'typescript' THEN '#3178C6' ELSE '#888780' END AS color,
       least(15 + 5 * in_degree, 50) AS size, in_degree, in_cycle FROM nv""")
def q_node_view(spark, sf_dir):
    """J7 + F4-F6: node display rows (label, hover title, colour, size)."""
    from ..operators import view
    nodes, edges, scc = cycle_inputs(spark, sf_dir)
    return view.node_view(nodes, edges, scc)


@register("edge_view", REACH_SQL + """
SELECT e.repo_name, e.src, e.dst, (s.node IS NOT NULL AND d.node IS NOT NULL) AS in_cycle,
       CASE WHEN s.node IS NOT NULL AND d.node IS NOT NULL THEN '#E24B4A' ELSE '#555577' END AS color,
       1.5 AS width, 'to' AS arrows
FROM edges e LEFT JOIN cyc_nodes s ON s.repo_name = e.repo_name AND s.node = e.src
LEFT JOIN cyc_nodes d ON d.repo_name = e.repo_name AND d.node = e.dst""")
def q_edge_view(spark, sf_dir):
    """J8 + F7: edge display rows; red when both ends lie on cycles."""
    from ..operators import view
    _, edges, scc = cycle_inputs(spark, sf_dir)
    return view.edge_view(edges, scc)


@register("index_admission", CHUNKS_SQL + f""", {REQ_SQL},
cnt AS (SELECT repo_name, count(*) AS n FROM chunks GROUP BY ALL)
SELECT req.repo_name, CAST(coalesce(n, 0) AS BIGINT) AS n_chunks,
       CASE WHEN coalesce(n, 0) = 0 OR coalesce(n, 0) > 150 THEN 'error' ELSE 'success' END AS status,
       CASE WHEN coalesce(n, 0) = 0 THEN 'No chunks provided — nothing to embed.'
            WHEN n > 150 THEN 'Repository too large. ' || n || ' chunks exceeds limit.' ELSE '' END AS message
FROM req LEFT JOIN cnt USING (repo_name)""")
def q_index_admission(spark, sf_dir):
    """Empty / oversize guard before the index write (limit 150 here so both outcomes occur)."""
    from ..sources import store
    return store.index_admission(chunk.chunk_files(selected(spark, sf_dir)), requested_repos(spark, sf_dir), 150)


@register("repos_without_sources", f"""
WITH {S.selected_cte()}, {REQ_SQL}
SELECT repo_name, 'error' AS status, 'No supported source files found. Supported: .py, .js, .ts, .jsx, .tsx' AS message
FROM req WHERE repo_name NOT IN (SELECT repo_name FROM sel)""")
def q_repos_without_sources(spark, sf_dir):
    """Requested repositories with no selected file become error rows."""
    return select.repos_without_sources(requested_repos(spark, sf_dir), selected(spark, sf_dir))


def _refactor_sql():
    from ..operators.prompt import REFACTOR_HEAD, REFACTOR_TAIL
    return CHUNKS_SQL + f""",
blocks AS (SELECT repo_name, chunk_id, '--- File: ' || file_path || ' | ' || upper(substr(chunk_type, 1, 1))
             || lower(substr(chunk_type, 2)) || ': ' || name || ' | Lines: ' || start_line || '-' || end_line
             || ' ---' || chr(10) || text AS b FROM chunks WHERE chunk_id < 15)
SELECT repo_name, 'refactor' AS task,
       {_sql_str(REFACTOR_HEAD)} || string_agg(b, chr(10) || chr(10) ORDER BY chunk_id) || {_sql_str(REFACTOR_TAIL)} AS prompt,
       CAST(0.3 AS DOUBLE) AS temperature FROM blocks GROUP BY ALL"""


@register("refactor_prompts", _refactor_sql())
def q_refactor_prompts(spark, sf_dir):
    """T4: refactoring prompt per repository from its first 15 chunks."""
    from ..operators import prompt, vectors
    return prompt.refactor_prompts(vectors.sample_chunks(chunk.chunk_files(selected(spark, sf_dir)), 15))


# V1 in SQL: hashed word counts of chunks and questions, document frequencies of the chunks alone.
ENCODE_SQL = CHUNKS_SQL + """,
texts AS (SELECT repo_name, chunk_id, NULL AS query_id, text FROM chunks UNION ALL
          SELECT concat('repo', CAST(conv_id % 5 AS VARCHAR)), NULL, conv_id * 1000 + turn, text FROM conversations WHERE role = 'user'),
words AS (SELECT repo_name, chunk_id, query_id, unnest([t FOR t IN string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+') IF t <> '']) AS t FROM texts),
tf AS MATERIALIZED (SELECT repo_name, chunk_id, query_id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS INTEGER) AS bucket, count(*) AS c FROM words GROUP BY ALL),
stats AS (SELECT bucket, count(*) AS df FROM tf WHERE chunk_id IS NOT NULL GROUP BY bucket),
tw AS (SELECT tf.*, c * (ln(((SELECT count(*) FROM chunks) + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) AS w FROM tf LEFT JOIN stats USING (bucket)),
enc AS MATERIALIZED (SELECT repo_name, chunk_id, query_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY repo_name, chunk_id, query_id)) AS w FROM tw)"""


def fitted_parts(spark, sf_dir):
    """(chunks, fitted encoder); the statistics are fitted on the chunks and stored beside them."""
    from ..operators import vectors
    from ..session import materialize, scratch_path
    chunks = materialize(chunk.chunk_files(selected(spark, sf_dir)), "chunks")
    return chunks, vectors.fit_encoder(chunks, scratch_path(spark, "encoder"))


def user_questions(spark, sf_dir):
    """The user turns of ``conversations``, each asking repo{conv_id % 5}."""
    from ..sources.corpus import table
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
                       F.concat(F.lit("repo"), (F.col("conv_id") % 5).cast("string")).alias("repo_name"),
                       F.col("text").alias("question"))


def encoded_parts(spark, sf_dir):
    """(chunks with vectors, questions, fitted encoder)."""
    from ..operators import vectors
    from ..session import materialize
    chunks, fitted = fitted_parts(spark, sf_dir)
    return materialize(vectors.encode(chunks, fitted), "chunk-vectors"), user_questions(spark, sf_dir), fitted


@register("chunk_encodings", ENCODE_SQL + """
SELECT repo_name, chunk_id, bucket, round(w, 4) AS weight FROM enc WHERE chunk_id IS NOT NULL""")
def q_chunk_encodings(spark, sf_dir):
    """V1: the non-zero elements of every chunk's vector."""
    from ..operators import vectors
    chunks, fitted = fitted_parts(spark, sf_dir)
    idx = vectors.encode(chunks.select("repo_name", "chunk_id", "text"), fitted)    # used once: vectors are not stored
    return (idx.select("repo_name", "chunk_id", F.posexplode("embedding").alias("bucket", "w")).filter("w <> 0")
            .select("repo_name", "chunk_id", "bucket", F.round("w", 4).alias("weight")))


@register("answer_chunks", ENCODE_SQL + """,
sim AS (SELECT q.query_id, q.repo_name, v.chunk_id, round(sum(q.w * v.w), 9) AS raw FROM enc q JOIN enc v
        ON q.repo_name = v.repo_name AND q.bucket = v.bucket WHERE q.query_id IS NOT NULL AND v.chunk_id IS NOT NULL GROUP BY ALL),
asked AS (SELECT query_id, repo_name, question FROM (SELECT conv_id * 1000 + turn AS query_id, text AS question,
            concat('repo', CAST(conv_id % 5 AS VARCHAR)) AS repo_name FROM conversations WHERE role = 'user')
          WHERE repo_name IN (SELECT repo_name FROM chunks)),
allsim AS (SELECT a.query_id, a.repo_name, c.chunk_id, coalesce(s.raw, 0) AS raw FROM asked a JOIN chunks c ON c.repo_name = a.repo_name
           LEFT JOIN sim s ON s.query_id = a.query_id AND s.chunk_id = c.chunk_id AND s.repo_name = a.repo_name),
hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM allsim
        QUALIFY rank <= 5)
SELECT query_id, repo_name, CAST(rank AS INTEGER) AS rank, chunk_id, round(raw, 3) AS score FROM hit""")
def q_answer_chunks(spark, sf_dir):
    """V1 + K6 + J6: the five chunks that answer each user turn of ``conversations`` in repo{conv_id % 5}."""
    from ..operators import vectors
    from ..session import materialize
    chunks, fitted = fitted_parts(spark, sf_dir)
    # texts are no part of the answer and not stored beside the vectors; with the path, a chunk that comes twice is still two hits
    idx = materialize(vectors.encode(chunks.select("repo_name", "chunk_id", "file_path", "text"), fitted).drop("text"), "chunk-vectors")
    asked = vectors.encode(vectors.known_repos(user_questions(spark, sf_dir), chunks), fitted, "question").drop("question")
    return vectors.search(idx, asked, top_k=5, digits=3).select("query_id", "repo_name", "rank", "chunk_id", "score")


def _answer_sql():
    from ..operators.prompt import ANSWER_HEAD, ANSWER_MID, ANSWER_TAIL
    blocks = ("'--- File: ' || file_path || ' | ' || upper(substr(chunk_type, 1, 1)) || lower(substr(chunk_type, 2)) || ': ' || name "
              "|| ' | Lines: ' || start_line || '-' || end_line || ' ---' || chr(10) || text")
    ctes = ORACLE["answer_chunks"][:ORACLE["answer_chunks"].rindex("SELECT query_id, repo_name, CAST(rank")]
    return ctes + f""",
ctx AS (SELECT query_id, string_agg({blocks}, chr(10) || chr(10) ORDER BY rank) AS c FROM hit JOIN chunks USING (repo_name, chunk_id) GROUP BY ALL)
SELECT query_id, repo_name, 'answer' AS task, {_sql_str(ANSWER_HEAD)} || c || {_sql_str(ANSWER_MID)} || question || {_sql_str(ANSWER_TAIL)} AS prompt,
       CAST(0.3 AS DOUBLE) AS temperature FROM asked JOIN ctx USING (query_id)"""


@register("answer_prompts", _answer_sql())
def q_answer_prompts(spark, sf_dir):
    """T1 (+V1, K6, F3, J6): the prompt of each user turn; questions about repositories without an index get none."""
    from ..operators import prompt, vectors
    idx, qs, fitted = encoded_parts(spark, sf_dir)
    known = vectors.known_repos(qs, idx)
    return prompt.answer_prompts(vectors.search(idx, vectors.encode(known, fitted, "question"), top_k=5), known)


def _architecture_prompt_sql():
    from ..operators.prompt import ARCH_PARTS
    ctx = ORACLE["architecture_context"]
    ctx_ctes = ctx[ctx.index("ep AS ("):ctx.index("\nSELECT sz.repo_name")]
    te_cte = TOP_EDGES_SQL[len(GRAPH_SQL):TOP_EDGES_SQL.index("\nSELECT repo_name, rank, src, dst")]
    arch_ctes = ARCH_SQL[len(CHUNKS_SQL):]
    q = _sql_str
    lst = lambda c: f"array_to_string(coalesce({c}.l, []), chr(10))"
    return (CHUNKS_SQL + ",\n" + S.graph_cte(with_files=False) + te_cte + ",\n" + ctx_ctes + arch_ctes + """,
fl AS (SELECT repo_name, array_to_string(list_sort(list(DISTINCT file_path)), chr(10)) AS repo_structure
       FROM arch GROUP BY ALL)
SELECT sz.repo_name, 'architecture' AS task, """
            + f"{q(ARCH_PARTS[0])} || node_count || {q(ARCH_PARTS[1])} || edge_count || {q(ARCH_PARTS[2])} || {lst('ep')}"
            + f" || {q(ARCH_PARTS[3])} || {lst('md')} || {q(ARCH_PARTS[4])} || {lst('lm')} || {q(ARCH_PARTS[5])}"
            + f" || {lst('dp')} || {q(ARCH_PARTS[6])} || coalesce(fl.repo_structure, '') || {q(ARCH_PARTS[7])} AS prompt,"
            + """ CAST(0.4 AS DOUBLE) AS temperature
FROM sz LEFT JOIN ep USING (repo_name) LEFT JOIN md USING (repo_name) LEFT JOIN lm USING (repo_name)
LEFT JOIN dp USING (repo_name) LEFT JOIN fl USING (repo_name)""")


@register("architecture_prompts", _architecture_prompt_sql())
def q_architecture_prompts(spark, sf_dir):
    """T3 (+G9, G11, K5): the architecture prompt of each repository (no chunk text)."""
    from ..operators import graph, prompt, rank
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    files = rank.file_listing(rank.select_architecture_chunks(chunk.chunk_files(selected(spark, sf_dir)), 12))
    return prompt.architecture_prompts(graph.architecture_context(nodes, edges), files)

@register("resolved_imports_aligned", f"""
WITH {S.selected_cte()}, {S.graph_cte()},
k AS (SELECT DISTINCT repo_name, src, import_path, replace(import_path, '.', '/') AS m FROM imports WHERE language = 'python'),
c AS (SELECT k.repo_name, k.src, k.import_path, f.rel_path AS path,
        CASE WHEN f.rel_path = k.m || '.py' OR ends_with(f.rel_path, '/' || k.m || '.py') THEN 0 ELSE 1 END AS is_pkg
      FROM k JOIN sel f ON f.repo_name = k.repo_name
       AND (f.rel_path = k.m || '.py' OR ends_with(f.rel_path, '/' || k.m || '.py')
            OR f.rel_path = k.m || '/__init__.py' OR ends_with(f.rel_path, '/' || k.m || '/__init__.py')))
SELECT repo_name, src, import_path, path AS dst FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_name, src, import_path ORDER BY is_pkg,
    CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = regexp_extract(src, '^(.*)/[^/]*$', 1) THEN 0 ELSE 1 END,
    length(path), path) AS r FROM c) WHERE r = 1""")
def q_resolved_imports_aligned(spark, sf_dir):
    """J1 with ``segment_aligned=True``: only whole path segments match (``os`` no longer hits ``videos.py``)."""
    from ..operators import imports
    files, imps = import_parts(spark, sf_dir)
    return imports.resolve_python_imports(imps, files, segment_aligned=True)


# ------------------------------------------------------------- replies, lookups and round trips
def _job_folder(spark) -> str:
    """A fresh folder in the shared checkpoint folder, for tables that a query writes and reads back."""
    from ..session import scratch_path
    return scratch_path(spark, "store")


@register("file_cap_100", f"""
WITH {S.selected_cte()}
SELECT repo_name, rel_path, language FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY rel_path) AS rn FROM sel) WHERE rn <= 100""")
def q_file_cap_100(spark, sf_dir):
    """P7 with a cap of 100 files: repositories above and below it."""
    return select.select_sources(code_corpus(spark, sf_dir), max_files=100).select("repo_name", "rel_path", "language")


@register("normalized_paths", f"""
WITH {S.corpus_cte()}
SELECT repo_name, rel_path AS path FROM code_corpus""")
def q_normalized_paths(spark, sf_dir):
    """Paths that came with backslashes read like the others."""
    from ..functions.paths import normalize_path
    paths = code_corpus(spark, sf_dir).select("repo_name", F.translate("rel_path", "/", "\\").alias("given"))
    return paths.select("repo_name", normalize_path("given").alias("path"))


REPO_URL_SQL = """concat(CASE page_id % 6 WHEN 0 THEN 'http' ELSE 'https' END, '://', CASE page_id % 7 WHEN 0 THEN 'gitlab.com' ELSE 'github.com' END, '/o',
  CAST(page_id % 9 AS VARCHAR(20)), CASE page_id % 11 WHEN 0 THEN '' ELSE concat('/r-', CAST(page_id AS VARCHAR(20))) END,
  CASE page_id % 4 WHEN 1 THEN '.git' WHEN 2 THEN '/' WHEN 3 THEN '.git/' ELSE '' END)"""


@register("repo_urls", f"""
WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, {REPO_URL_SQL} FROM pages),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '/+$', ''), '\\.git$', '') AS c FROM u)
SELECT page_id, url, regexp_full_match(c, 'https?://github\\.com/[\\p{{L}}\\p{{N}}_.\\-]+/[\\p{{L}}\\p{{N}}_.\\-]+/?') AS is_repo, split_part(c, '/', -1) AS repo
FROM c""")
def q_repo_urls(spark, sf_dir):
    """P10 + P11: the urls of ``pages``, and repository urls made with their numbers, judged and named."""
    from ..functions.paths import is_repo_url, repo_of_url
    from ..sources.corpus import table
    pages = table(spark, sf_dir, "pages")
    urls = pages.select("page_id", "url").unionByName(pages.select("page_id", F.expr(REPO_URL_SQL).alias("url")))
    return urls.select("page_id", "url", is_repo_url("url").alias("is_repo"), repo_of_url("url").alias("repo"))


# replies made from the documents' numbers: every shape that the parser tells apart
REPLY_SQL = """CASE doc_id % 8
  WHEN 0 THEN '[]'
  WHEN 1 THEN concat('Here: [{"file":"a', k, '.py","line":"', k, '","severity":"high","issue":"i","suggestion":"s"}] done')
  WHEN 2 THEN concat('[{"line":', k, '.7},{"line":null},{"line":"x"},5,{"file":null},{"line":true,"issue":"', k, '"}]')
  WHEN 3 THEN '{"file":"a.py"}'
  WHEN 4 THEN '[LLM Error] x'
  WHEN 5 THEN concat('[{"file":"first","file":"last', k, '","line":30', k, '00000000}]')
  WHEN 6 THEN concat('[{"file":"a"}, {"broken": ', k, ' ]')
  ELSE concat('no array, only text ', k) END"""
REPLY_REPO_SQL = "concat('repo', CAST(doc_id % 5 AS VARCHAR(20)))"
FINDINGS_SQL = f"""
WITH d AS (SELECT doc_id, {REPLY_REPO_SQL} AS repo_name, CAST(doc_id AS VARCHAR) AS k FROM documents),
f AS (SELECT doc_id, repo_name, 0 AS pos, 'a' || k || '.py' AS file, doc_id AS line, 'high' AS severity, 'i' AS issue, 's' AS suggestion FROM d WHERE doc_id % 8 = 1
      UNION ALL SELECT doc_id, repo_name, 0, 'unknown', doc_id, 'low', '', '' FROM d WHERE doc_id % 8 = 2
      UNION ALL SELECT doc_id, repo_name, 4, 'None', 0, 'low', '', '' FROM d WHERE doc_id % 8 = 2
      UNION ALL SELECT doc_id, repo_name, 5, 'unknown', 1, 'low', k, '' FROM d WHERE doc_id % 8 = 2
      UNION ALL SELECT doc_id, repo_name, 0, 'last' || k, CAST('30' || k || '00000000' AS BIGINT), 'low', '', '' FROM d WHERE doc_id % 8 = 5)"""


def review_replies(spark, sf_dir):
    from ..sources.corpus import table
    docs = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("request_id"), F.expr(REPLY_REPO_SQL).alias("repo_name"), F.expr(REPLY_SQL).alias("reply"))


@register("review_findings", FINDINGS_SQL + """
SELECT repo_name, doc_id AS request_id, pos, file, line, severity, issue, suggestion FROM f""")
def q_review_findings(spark, sf_dir):
    """F10 + F11: typed findings of one reply per document."""
    from ..operators import replies
    return replies.findings(review_replies(spark, sf_dir))


@register("review_totals", FINDINGS_SQL + f""",
{S.selected_cte()}, {REQ_SQL}
SELECT req.repo_name, CASE WHEN n.repo_name IS NULL THEN 'not indexed' ELSE 'success' END AS status,
       CASE WHEN n.repo_name IS NULL THEN 0 ELSE (SELECT count(*) FROM f WHERE f.repo_name = req.repo_name) END AS total
FROM req LEFT JOIN (SELECT DISTINCT repo_name FROM sel) n USING (repo_name)""")
def q_review_totals(spark, sf_dir):
    """E3 + G12: findings of every requested repository, with a row for those without any and for unknown ones."""
    from ..operators import replies
    from . import jobs
    return jobs.review_totals(selected(spark, sf_dir), replies.findings(review_replies(spark, sf_dir)), requested_repos(spark, sf_dir))


ARCH_REPLY_SQL = """CASE doc_id % 5
  WHEN 0 THEN concat('SUMMARY: s', k, nl, fence, 'mermaid', nl, 'flowchart TD', nl, 'A', k, '-->B', nl, fence, ' and more')
  WHEN 1 THEN concat('  only text ', k, ' ')
  WHEN 2 THEN concat('t', k, ' ', fence, 'mermaid', nl, 'A-->B')
  WHEN 3 THEN concat('[LLM Error] ', k)
  ELSE concat(fence, 'mermaid', nl, fence, ' after ', k) END"""


def _architecture_replies_sql():
    from ..operators.replies import FAILED_DIAGRAM, FAILED_SUMMARY, MISSING_DIAGRAM
    return f"""
WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k FROM documents)
SELECT doc_id AS request_id, doc_id % 5 <> 3 AS saved,
  CASE doc_id % 5 WHEN 0 THEN 'SUMMARY: s' || k WHEN 1 THEN 'only text ' || k WHEN 2 THEN 't' || k WHEN 3 THEN {_sql_str(FAILED_SUMMARY)} ELSE '' END AS summary,
  CASE doc_id % 5 WHEN 0 THEN 'flowchart TD' || chr(10) || 'A' || k || '-->B' WHEN 3 THEN {_sql_str(FAILED_DIAGRAM)} ELSE {_sql_str(MISSING_DIAGRAM)} END AS mermaid
FROM d"""


def architecture_replies(spark, sf_dir):
    from ..operators import replies
    from ..sources.corpus import table
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("k"), F.lit("\n").alias("nl"), F.lit("`" * 3).alias("fence"))
    return replies.architecture_results(docs.select(F.col("doc_id").alias("request_id"), F.expr(ARCH_REPLY_SQL).alias("reply")))


@register("architecture_replies", _architecture_replies_sql())
def q_architecture_replies(spark, sf_dir):
    """F8 + F9: summary and diagram of one reply per document, with the fallbacks."""
    return architecture_replies(spark, sf_dir).select("request_id", "saved", "summary", "mermaid")


@register("metadata_round_trip", """
WITH d AS (SELECT concat('doc', CAST(doc_id % 50 AS VARCHAR)) AS repo_name, doc_id FROM documents),
l AS (SELECT repo_name, max(doc_id) AS doc_id FROM d GROUP BY ALL),
req AS (SELECT DISTINCT concat('doc', CAST(doc_id % 60 AS VARCHAR)) AS repo_name FROM documents)
SELECT req.repo_name, CASE WHEN l.repo_name IS NULL THEN 'missing' ELSE 'success' END AS status, 'v' || doc_id AS summary,
       CASE WHEN l.repo_name IS NULL THEN NULL ELSE md5(l.repo_name) END AS metadata_id
FROM req LEFT JOIN l USING (repo_name)""")
def q_metadata_round_trip(spark, sf_dir):
    """S8 + S9 + J9 + E4 + F13: two batches of updates, the later row of a repository stays; read-through of more repositories."""
    from ..sources import store
    from ..sources.corpus import table
    docs = table(spark, sf_dir, "documents")
    path = _job_folder(spark)
    rows = docs.select("doc_id", F.concat(F.lit("doc"), (F.col("doc_id") % 50).cast("string")).alias("repo_name"),
                       F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("summary"))
    middle = rows.agg(F.expr("percentile_approx(doc_id, 0.5)")).first()[0] or 0
    store.upsert_metadata(spark, path, rows.filter(F.col("doc_id") <= middle), order="doc_id")
    later = rows.filter(F.col("doc_id") > middle)
    if not later.isEmpty():
        store.upsert_metadata(spark, path, later, order="doc_id")
    asked = docs.select(F.concat(F.lit("doc"), (F.col("doc_id") % 60).cast("string")).alias("repo_name")).distinct()
    return (store.read_through(asked, store.read_chunk_index(spark, path))
            .select("repo_name", "status", "summary", "metadata_id"))


@register("index_round_trip", f"""
WITH {S.selected_cte()}
SELECT repo_name, rel_path, CASE WHEN repo_name = 'repo1' THEN 'second' ELSE 'first' END AS version FROM sel
WHERE repo_name <> 'repo1' OR language = 'python'""")
def q_index_round_trip(spark, sf_dir):
    """A second write replaces all rows of its repository and leaves the others."""
    from ..sources import store
    files = selected(spark, sf_dir).select("repo_name", "rel_path", "language")
    path = _job_folder(spark)
    store.write_chunk_index(files.withColumn("version", F.lit("first")), path)
    store.write_chunk_index(files.filter("repo_name = 'repo1' and language = 'python'").withColumn("version", F.lit("second")), path)
    return store.read_chunk_index(spark, path).select("repo_name", "rel_path", "version")


@register("graph_round_trip", GRAPH_SQL + """
SELECT repo_name, src, dst, CAST(row_number() OVER (PARTITION BY repo_name ORDER BY src, first_ord, dst) - 1 AS BIGINT) AS place FROM edges""")
def q_graph_round_trip(spark, sf_dir):
    """S10 + S11: edges after packing the graph and unpacking it again, in stored order."""
    from ..operators import graph
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    return graph.unpack_graph(graph.pack_graph(nodes, edges))[1].select("repo_name", "src", "dst", F.col("first_ord").alias("place"))


@register("graph_blocks", GRAPH_SQL + """
SELECT repo_name, src, dst, row_number() OVER (PARTITION BY repo_name, src ORDER BY first_ord, dst) - 1 AS place FROM edges""")
def q_graph_blocks(spark, sf_dir):
    """S10 + S11 in blocks of 16 nodes: edges after storing the adjacency blocks and reading them back."""
    from ..operators import graph
    from ..sources import store
    _, _, _, nodes, edges = graph_parts(spark, sf_dir)
    path = _job_folder(spark)
    store.write_chunk_index(graph.graph_blocks(nodes, edges, 16), path)
    back = graph.from_blocks(store.read_chunk_index(spark, path), 16)[1]
    return back.select("repo_name", "src", "dst", F.col("first_ord").alias("place"))


@register("result_counts", CHUNKS_SQL + """
SELECT f.repo_name, files_indexed, coalesce(chunks_stored, 0) AS chunks_stored
FROM (SELECT repo_name, count(*) AS files_indexed FROM sel GROUP BY ALL) f
LEFT JOIN (SELECT repo_name, count(*) AS chunks_stored FROM chunks GROUP BY ALL) c USING (repo_name)""")
def q_result_counts(spark, sf_dir):
    """Files indexed and chunks stored per repository."""
    from . import jobs
    files = selected(spark, sf_dir)
    return jobs.result_counts(files, chunk.chunk_files(files))


# --------------------------------------------------------------------- jobs with a canned responder
def _responder():
    """A stand-in for a model, built inside a function so that workers get it by value."""
    def responder(text, temperature, max_tokens=0):
        if "mermaid" in text:
            return "SUMMARY: modules\n" + "`" * 3 + "mermaid\nflowchart TD\nA --> B\n" + "`" * 3
        if text.startswith("call ") and int(text[5:]) % 7 == 0:
            raise ValueError(f"no answer to {text}")
        if text.startswith("call ") and int(text[5:]) % 11 == 0:
            return "[LLM Error] refused"
        return f"  {text[:20]}/{temperature}/{max_tokens} "
    return responder


@register("model_calls", """
SELECT doc_id AS request_id, doc_id % 7 = 0 OR doc_id % 11 = 0 AS is_error,
  CASE WHEN doc_id % 7 = 0 THEN '[LLM Error] ValueError: no answer to call ' || doc_id WHEN doc_id % 11 = 0 THEN '[LLM Error] refused'
       ELSE 'call ' || doc_id || '/0.5/64' END AS reply
FROM documents""")
def q_model_calls(spark, sf_dir):
    """V4: one call per document; errors are replies, the token budget reaches the responder."""
    from ..operators import replies
    from ..sources.corpus import table
    prompts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), F.concat(F.lit("call "), F.col("doc_id").cast("string")).alias("prompt"), F.lit(0.5).alias("temperature"))
    return replies.infer(prompts, _responder(), max_tokens=64)


def _index_job(spark, sf_dir, max_chunks: int | None = None):
    """(status rows, folder) of the whole index job over the code corpus; repositories above ``max_chunks`` are refused."""
    from ..session import materialize
    from . import jobs
    out = _job_folder(spark)
    return materialize(jobs.index_repositories(code_corpus(spark, sf_dir), out, _responder(), max_chunks=max_chunks), "status"), out


JOB_SQL = CHUNKS_SQL + """,
cnt AS (SELECT repo_name, count(*) AS n FROM chunks GROUP BY ALL),
job AS (SELECT f.repo_name, coalesce(n, 0) AS n_chunks, CASE WHEN coalesce(n, 0) BETWEEN 1 AND 200 THEN 'success' ELSE 'error' END AS status,
          CASE WHEN coalesce(n, 0) = 0 THEN 'No chunks provided — nothing to embed.'
               WHEN n > 200 THEN 'Repository too large. ' || n || ' chunks exceeds limit.' ELSE '' END AS message, files_indexed
        FROM (SELECT repo_name, count(*) AS files_indexed FROM sel GROUP BY ALL) f LEFT JOIN cnt USING (repo_name))"""


@register("index_job", JOB_SQL + """
SELECT repo_name, n_chunks, status, message, files_indexed, CASE WHEN status = 'success' THEN n_chunks ELSE 0 END AS chunks_stored FROM job""")
def q_index_job(spark, sf_dir):
    """E1 (with S5 at 200 chunks): status of every repository after the whole job."""
    return _index_job(spark, sf_dir, 200)[0].select("repo_name", "n_chunks", "status", "message", "files_indexed", "chunks_stored")


# the same without the limit of 200 chunks
WHOLE_JOB_SQL = CHUNKS_SQL + """,
cnt AS (SELECT repo_name, count(*) AS n FROM chunks GROUP BY ALL),
job AS (SELECT f.repo_name, coalesce(n, 0) AS n_chunks, CASE WHEN coalesce(n, 0) >= 1 THEN 'success' ELSE 'error' END AS status
        FROM (SELECT DISTINCT repo_name FROM sel) f LEFT JOIN cnt USING (repo_name))"""


@register("asked_index", WHOLE_JOB_SQL + """
SELECT conv_id * 1000 + turn AS query_id, concat('repo', CAST(conv_id % 6 AS VARCHAR)) AS repo_name,
       CASE WHEN status = 'success' THEN 'success' ELSE 'not indexed' END AS status,
       CASE WHEN status = 'success' THEN 'You are reviewing a /0.3/2048' END AS answer,
       CASE WHEN status = 'success' THEN least(n_chunks, 5) ELSE 0 END AS chunks_used
FROM conversations LEFT JOIN job ON job.repo_name = concat('repo', CAST(conv_id % 6 AS VARCHAR)) WHERE role = 'user'""")
def q_asked_index(spark, sf_dir):
    """Every user turn asks a repository of the stored index, whatever its size; unknown ones are told apart from answers."""
    from ..sources import store
    from ..sources.corpus import table
    from . import jobs
    _, out = _index_job(spark, sf_dir)
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    qs = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
                     F.concat(F.lit("repo"), (F.col("conv_id") % 6).cast("string")).alias("repo_name"), F.col("text").alias("question"))
    answers = jobs.ask(store.read_chunk_index(spark, f"{out}/chunk_index"), qs, _responder(), fitted=spark.read.parquet(f"{out}/encoder"))
    return answers.select("query_id", "repo_name", "status", "answer", F.col("chunks_used").cast("long").alias("chunks_used"))


@register("stored_views", JOB_SQL + ",\n" + S.graph_cte(with_files=False) + REACH_SQL[len(GRAPH_SQL):] + """
SELECT d.repo_name, d.node, d.in_degree, c.node IS NOT NULL AS in_cycle, 'SUMMARY: modules' AS summary
FROM deg d JOIN job ON job.repo_name = d.repo_name AND job.status = 'success'
LEFT JOIN cyc_nodes c ON c.repo_name = d.repo_name AND c.node = d.node""")
def q_stored_views(spark, sf_dir):
    """E4 + E5: nodes of the stored graphs as they are displayed, with the stored summary."""
    from ..sources import store
    from . import jobs
    _, out = _index_job(spark, sf_dir, 200)
    meta = store.read_chunk_index(spark, f"{out}/repo_metadata")
    blocks = store.read_chunk_index(spark, f"{out}/graph_blocks")
    nodes, _, _ = jobs.dependency_view(meta, requested_repos(spark, sf_dir), blocks)
    summary = jobs.architecture_of(meta, requested_repos(spark, sf_dir)).select("repo_name", "summary")
    return nodes.join(summary, "repo_name").select("repo_name", "node", "in_degree", "in_cycle", "summary")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

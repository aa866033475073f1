"""End-to-end jobs (E1-E6, G8, G12): compositions of the operators, keyed by repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunk, cycles, graph, imports, prompt, rank, replies, select, vectors
from ..sources import store
from ..session import ensure_checkpoint_dir, materialize


def graph_stats(nodes: DataFrame, edges: DataFrame, budget: int | None = None, scc: DataFrame | None = None) -> DataFrame:
    """``nodes, edges, cycles, cycles_complete, most_depended_on`` per repository."""
    size = graph.graph_size(nodes, edges)
    counts = cycles.cycle_counts(edges, nodes, budget, scc=scc)
    top = graph.most_depended_on(graph.degrees(nodes, edges), 5, positive=True)
    md = top.groupBy("repo_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file", "imported_by"))),
                                                  lambda x: F.struct(x["file"].alias("file"),
                                                                     x["imported_by"].alias("imported_by")))
                                      .alias("most_depended_on"))
    empty = F.array().cast("array<struct<file:string,imported_by:bigint>>")
    return (size.join(counts, "repo_name", "left").join(md, "repo_name", "left")
            .select("repo_name", "nodes", "edges", F.coalesce("cycles", F.lit(0)).alias("cycles"),
                    F.coalesce("complete", F.lit(True)).alias("cycles_complete"),
                    F.coalesce("most_depended_on", empty).alias("most_depended_on")))


def result_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files indexed and chunks stored per repository."""
    f = files.groupBy("repo_name").agg(F.count(F.lit(1)).alias("files_indexed"))
    c = chunks.groupBy("repo_name").agg(F.count(F.lit(1)).alias("chunks_stored"))
    return f.join(c, "repo_name", "left").fillna(0, ["chunks_stored"])


def index_repositories(files: DataFrame, out: str, responder, encoder=None, max_files: int | None = None,
                       max_chunks: int | None = None, cycle_budget: int | None = None) -> DataFrame:
    """Select → chunk → admit → embed → write index; graph → stats/context → prompt →
    model → summary/diagram → metadata upsert.  Returns one status row per repository.

    ``max_files`` and ``max_chunks`` are off unless asked for (500 and 1000 in the reference).
    Graphs are stored in blocks under ``graph_blocks``, whatever their size.
    """
    spark = files.sparkSession
    ensure_checkpoint_dir(spark)
    repos = files.select("repo_name").distinct()
    sel = materialize(select.select_sources(files, max_files), "source-files")
    missing = select.repos_without_sources(repos, sel)
    chunks = chunk.chunk_files(sel)
    admission = materialize(store.index_admission(chunks, repos, max_chunks), "admission")
    # five steps below read the chunks, whose ids come from a join
    admitted = materialize(chunks.join(admission.filter("status = 'success'").select("repo_name"), "repo_name", "left_semi"), "admitted")
    if encoder is None:                         # fitted once on what is indexed, stored beside it for the query side
        embedded = vectors.encode(admitted, vectors.fit_encoder(admitted, f"{out}/encoder"))
    else:
        embedded = vectors.embed(admitted, "text", encoder)
    # stored first: the range sort of the write samples its input, which would encode every chunk twice
    store.write_chunk_index(materialize(embedded, "embedded"), f"{out}/chunk_index")
    imps = materialize(imports.extract_imports(sel), "imports")     # every branch below would read the files again
    nodes, edges = graph.graph_nodes(sel), graph.graph_edges(imports.resolve_imports(imps, sel), imps)
    edges = materialize(edges, "edges")
    store.write_chunk_index(graph.graph_blocks(nodes, edges), f"{out}/graph_blocks")
    stats = graph_stats(nodes, edges, cycle_budget)
    ctx = graph.architecture_context(nodes, edges)
    # a refused repository costs no model call and gets no metadata
    ctx = ctx.join(admission.filter("status = 'success'").select("repo_name"), "repo_name", "left_semi")
    arch_chunks = rank.select_architecture_chunks(admitted, 12)
    prompts = prompt.architecture_prompts(ctx, rank.file_listing(arch_chunks)).withColumnRenamed("repo_name", "request_id")
    results = replies.architecture_results(replies.infer(prompts, responder)).withColumnRenamed("request_id", "repo_name")
    gs = stats.select("repo_name", F.struct("nodes", "edges", "cycles", "cycles_complete",
                                            "most_depended_on").alias("graph_stats"))
    ac = ctx.select("repo_name", F.struct("entry_points", "most_depended_on", "largest_modules", "dependencies",
                                          "node_count", "edge_count").alias("architecture_context"))
    meta = (results.filter("saved").select("repo_name", "summary", "mermaid")
            .join(gs, "repo_name").join(ac, "repo_name"))
    store.upsert_metadata(spark, f"{out}/repo_metadata", meta)
    counts = result_counts(sel, admitted)
    admission = admission.join(missing.select("repo_name"), "repo_name", "left_anti")
    return (admission.join(counts, "repo_name", "left").unionByName(
        missing.withColumn("n_chunks", F.lit(0).cast("bigint")).withColumn("files_indexed", F.lit(0).cast("bigint"))
        .withColumn("chunks_stored", F.lit(0).cast("bigint")), allowMissingColumns=True))


def ask(index: DataFrame, questions: DataFrame, responder, encoder=None, top_k: int = 5,
        fitted: DataFrame | None = None) -> DataFrame:
    """``repo_name, question, answer, chunks_used`` (unknown repository → status row).

    Questions are encoded as the index was: by the same ``encoder``, or by the statistics that the index job
    stored under ``encoder`` beside the index (``fitted``).
    """
    if encoder is None and fitted is None:
        raise ValueError("pass the encoder of the index, or the statistics that were fitted with it")
    q = vectors.known_repos(questions, index)
    asked = vectors.embed(q, "question", encoder) if fitted is None else vectors.encode(q, fitted, "question")
    hits = vectors.search(index, asked, top_k)
    prompts = prompt.answer_prompts(hits, q).withColumnRenamed("query_id", "request_id")
    ans = replies.infer(prompts, responder).withColumnRenamed("request_id", "query_id")
    used = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks_used"))
    return (questions.join(ans, "query_id", "left").join(used, "query_id", "left")
            .select("query_id", "repo_name", "question",
                    F.when(F.col("chunks_used").isNull(), F.lit("not indexed")).otherwise("success").alias("status"),
                    F.col("reply").alias("answer"), F.coalesce("chunks_used", F.lit(0)).alias("chunks_used")))


def review(index: DataFrame, responder, limit: int = 15, max_findings: int | None = None) -> DataFrame:
    """Sample → review prompt → model → findings (optional severity-sorted cap)."""
    sample = vectors.sample_chunks(index, limit)
    prompts = prompt.review_prompts(sample).withColumn("request_id", F.col("repo_name"))
    found = replies.findings(replies.infer(prompts, responder).withColumn("repo_name", F.col("request_id")))
    if max_findings is not None:
        from pyspark.sql import Window
        sev = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
        w = Window.partitionBy("repo_name").orderBy(sev, "pos")
        found = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_findings).drop("_r")
    return found


def review_totals(index: DataFrame, found: DataFrame, repos: DataFrame) -> DataFrame:
    """``repo_name, status, total`` of every requested repository, also of those without findings.

    Repositories that are not indexed have status ``not indexed``; the others ``success``, with 0 where the
    review found nothing.
    """
    known = index.select("repo_name").distinct().withColumn("_known", F.lit(True))
    counts = found.groupBy("repo_name").agg(F.count(F.lit(1)).alias("total"))
    return (repos.select("repo_name").distinct().join(known, "repo_name", "left").join(counts, "repo_name", "left")
            .select("repo_name", F.when(F.col("_known"), "success").otherwise("not indexed").alias("status"),
                    F.when(F.col("_known"), F.coalesce("total", F.lit(0))).otherwise(0).cast("bigint").alias("total")))


def architecture_of(metadata: DataFrame, repos: DataFrame) -> DataFrame:
    """Stored summary and diagram, or a ``missing`` status (never regenerated)."""
    return store.read_through(repos, metadata).select("repo_name", "status", "summary", "mermaid")


def dependency_view(metadata: DataFrame, repos: DataFrame, blocks: DataFrame):
    """E5: node and edge display tables + stored stats for the requested repositories.

    ``blocks`` is the table ``graph_blocks`` of the index job; only the blocks of requested repositories with
    stored metadata are read.
    """
    from ..operators import view
    found = store.read_through(repos, metadata).filter("status = 'success'")
    nodes, edges = graph.from_blocks(blocks.join(found.select("repo_name"), "repo_name", "left_semi"))
    cyc = cycles.cycle_nodes(edges)
    return (view.node_view(nodes, edges, cyc), view.edge_view(edges, cyc),
            found.select("repo_name", "graph_stats"))


def status(index: DataFrame, repos: DataFrame) -> DataFrame:
    """Indexed flag and chunk count."""
    return vectors.index_status(index, repos)

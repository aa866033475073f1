"""Findings of round three: refused repositories, repeated work of the index job, bounded Python memory."""

from srcatlas.plans import jobs
from srcatlas.sources import store
from test_jobs import corpus, make_responder


def test_index_of_refused_repositories_is_empty_and_readable(spark, tmp_path):
    out = str(tmp_path / "store")
    status = {r.repo_name: r.status for r in jobs.index_repositories(corpus(spark), out, make_responder(), max_chunks=1).collect()}
    assert status == {"alpha": "error", "beta": "error"}

    index = store.read_chunk_index(spark, f"{out}/chunk_index")
    assert index.count() == 0 and {"repo_name", "chunk_id", "text", "embedding"} <= set(index.columns)
    questions = spark.createDataFrame([(1, "alpha", "where is connect")], "query_id long, repo_name string, question string")
    answers = jobs.ask(index, questions, make_responder(), fitted=spark.read.parquet(f"{out}/encoder")).collect()
    assert [(r.query_id, r.status, r.chunks_used) for r in answers] == [(1, "not indexed", 0)]

    meta = store.read_chunk_index(spark, f"{out}/repo_metadata")
    repos = spark.createDataFrame([("alpha",)], "repo_name string")
    assert [r.status for r in jobs.architecture_of(meta, repos).collect()] == ["missing"]
    nodes, edges, stats = jobs.dependency_view(meta, repos, store.read_chunk_index(spark, f"{out}/graph_blocks"))
    assert nodes.count() == edges.count() == stats.count() == 0


def test_first_rows_after_an_empty_write(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("alpha", 0, "x")], "repo_name string, chunk_id long, text string")
    store.write_chunk_index(rows.filter("chunk_id < 0"), path)
    assert store.read_chunk_index(spark, path).columns == ["chunk_id", "text", "repo_name"]
    store.write_chunk_index(rows, path)
    back = store.read_chunk_index(spark, path)
    assert back.columns == ["chunk_id", "text", "repo_name"] and [tuple(r) for r in back.collect()] == [(0, "x", "alpha")]


def test_block_search_equals_double_precision():
    import numpy as np

    from srcatlas.operators import vectors

    rng = np.random.default_rng(3)
    m = rng.standard_normal((3000, 24))
    m[500:900] = m[7]                                   # equal vectors tie
    m[1000:1400] = m[7] * (1 + 1e-9 * rng.standard_normal((400, 24)))       # closer than single precision can tell
    m[40] = 0.0
    m[41] *= 1e12
    q = np.concatenate([m[[7, 40, 41, 1200]], rng.standard_normal((60, 24)), np.zeros((1, 24))])
    lengths, q_lengths = np.sqrt((m * m).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    norms = q_lengths[:, None] * lengths[None, :]
    exact = np.round(np.divide(q @ m.T, norms, out=np.zeros_like(norms), where=norms > 0), 12)
    owner, row, score = vectors._Block(m, lengths).best(q, q_lengths, 5)
    assert owner.tolist() == [i for i in range(len(q)) for _ in range(5)]
    want = np.argsort(-exact, axis=1, kind="stable")[:, :5]
    assert row.reshape(-1, 5).tolist() == want.tolist()
    assert np.allclose(score.reshape(-1, 5), np.take_along_axis(exact, want, 1), atol=1e-11)


def test_large_repositories_get_larger_blocks(spark):
    """Queries are copied to every block: their number must not grow with the index without end."""
    from pyspark.sql import functions as F

    from srcatlas.operators import vectors

    index = spark.range(600).select(F.lit("r").alias("repo_name"), F.col("id").alias("chunk_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    queries = spark.range(3).select(F.lit("r").alias("repo_name"), F.col("id").alias("query_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    small = vectors._best_in_blocks(index.withColumnRenamed("embedding", "v"), queries.withColumnRenamed("embedding", "v"), ["repo_name"], 1, 4)
    assert small.count() == 3 * 32                      # 1,200 cells: 32 blocks of 37.5 cells, not 300 of 4
    hits = {r.query_id: r.chunk_id for r in vectors.search(index, queries, top_k=1, block_cells=4).collect()}
    assert hits == {0: 0, 1: 1, 2: 2}


def test_python_slices_are_bounded():
    import pyarrow as pa

    from srcatlas.session import SLICE_ROWS, sliced

    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(sliced([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) == SLICE_ROWS == 256
    assert [x for p in parts for x in p.column("x").to_pylist()] == list(range(1000))


def test_index_job_reads_imports_once(spark, tmp_path, monkeypatch):
    from srcatlas.operators import imports

    reads = spark.sparkContext.accumulator(0)
    extract = imports.extract_imports

    def counted(files):
        def run(batches):
            for batch in batches:
                reads.add(batch.num_rows)
                yield batch
        found = extract(files)
        return found.mapInArrow(run, found.schema)

    monkeypatch.setattr(imports, "extract_imports", counted)
    jobs.index_repositories(corpus(spark), str(tmp_path / "store"), make_responder()).collect()
    assert reads.value == 2                             # one import in each of the two files

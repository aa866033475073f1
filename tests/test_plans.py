"""Physical-plan shape checks: partial top-n, scan pushdown, no shuffle of the vector index."""

from pyspark.sql import functions as F

from srcatlas.operators import select, vectors


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_file_cap_uses_window_group_limit(spark):
    files = spark.createDataFrame([("r", f"m{i}.py", 10) for i in range(20)], "repo_name string, rel_path string, size bigint")
    plan = _plan(select.select_sources(files, max_files=5))
    assert "WindowGroupLimit" in plan


def test_sample_filter_reaches_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "idx")
    spark.range(100).select(F.lit("r").alias("repo_name"), F.col("id").alias("chunk_id"),
                            F.lit("t").alias("text")).write.partitionBy("repo_name").parquet(path)
    plan = _plan(vectors.sample_chunks(spark.read.parquet(path), 15))
    assert "PushedFilters: [IsNotNull(chunk_id), LessThan(chunk_id,15)]" in plan


def test_vector_search_has_no_join_of_pairs(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    idx = emb.select(F.col("label").cast("string").alias("repo_name"), F.col("vec_id").alias("chunk_id"), "embedding")
    qs = idx.filter("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), "repo_name", "embedding")
    plan = _plan(vectors.search(idx, qs, top_k=3))
    assert "MapInArrow" in plan and "WindowGroupLimit" in plan       # k rows per query and block leave a task
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan

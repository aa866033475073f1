"""SURVEY §5 properties: approximate search vs exact, definition span rules."""

from pyspark.sql import functions as F

from srcatlas.functions import lexing
from srcatlas.operators import definitions, vectors


def test_approximate_hits_are_exact_hits(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    idx = emb.select(F.lit("r").alias("repo_name"), F.col("vec_id").alias("chunk_id"), "embedding")
    qs = idx.filter("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "repo_name", "embedding")
    exact = vectors.search(idx, qs, top_k=500)
    scores = {(r.query_id, r.chunk_id): r.score for r in exact.collect()}
    approx = vectors.search_approx(idx, qs, top_k=5, tables=12, probes=4, bucket_rows=32)
    for r in approx.collect():
        assert scores[(r.query_id, r.chunk_id)] == r.score
    assert vectors.recall(approx, exact.filter("rank <= 5")).first().recall >= 0.9


def _spans(code):
    return {(c[2], c[3], c[4]) for c in definitions.cut(code, lexing.python_spans(code), 1, 3000, False)}


def test_python_span_rules():
    code = ("def a(x,\n"
            "      y):\n"
            "    z = [\n"
            "1, 2,\n"
            "]\n"
            "    return z\n"
            "# trailing comment\n"
            "\n"
            "def b():\n"
            "    '''doc\n"
            "def not_a_def():\n"
            "x = 1\n"
            "    '''\n"
            "    return 2\n"
            "c = 3\n")
    # brackets and strings carry a statement over lines of any indent; comments neither end nor extend it
    assert _spans(code) == {("a", 1, 6), ("b", 9, 14)}

"""End-to-end jobs E1-E6 on a tiny two-repository corpus with a canned responder."""

import pytest
from pyspark.sql import functions as F

from srcatlas.plans import jobs
from srcatlas.sources import store

SCHEMA = "repo_name string, rel_path string, content string, size bigint"
BODY = "    total = first + second + 1000000000000000000000\n    return total\n"


def make_responder():
    # built inside a function so cloudpickle ships it by value to the Python workers
    def responder(prompt, temperature):
        if "JSON array" in prompt:
            return '[{"file": "core/db.py", "line": "3", "severity": "high", "issue": "i", "suggestion": "s"}]'
        if "mermaid" in prompt:
            return "SUMMARY: two modules\n```mermaid\nflowchart TD\nA[main] --> B[db]\n```"
        return "The answer is in core/db.py at line 1."
    return responder


def corpus(spark):
    rows = [("alpha", "main.py", "import core.db\n\ndef main(first, second):\n" + BODY),
            ("alpha", "core/db.py", "import main\n\ndef connect(first, second):\n" + BODY),
            ("alpha", "node_modules/x.js", "ignored\n"),
            ("beta", "README.md", "no source here\n")]
    return spark.createDataFrame([(r, p, c, len(c.encode())) for r, p, c in rows], SCHEMA)


def test_index_ask_review_views(spark, tmp_path):
    out = str(tmp_path / "store")
    responder = make_responder()
    status = {r.repo_name: r for r in jobs.index_repositories(corpus(spark), out, responder).collect()}
    assert status["alpha"].status == "success" and status["alpha"].chunks_stored == 2
    assert status["beta"].status == "error"

    index = store.read_chunk_index(spark, f"{out}/chunk_index")
    meta = spark.read.parquet(f"{out}/repo_metadata")
    m = meta.filter("repo_name = 'alpha'").first()
    assert m.summary == "SUMMARY: two modules" and m.mermaid == "flowchart TD\nA[main] --> B[db]"
    assert m.graph_stats.nodes == 2 and m.graph_stats.edges == 2 and m.graph_stats.cycles == 1

    repos = spark.createDataFrame([("alpha",), ("gamma",)], "repo_name string")
    arch = {r.repo_name: r.status for r in jobs.architecture_of(meta, repos).collect()}
    assert arch == {"alpha": "success", "gamma": "missing"}

    nodes, edges, stats = jobs.dependency_view(meta, repos, store.read_chunk_index(spark, f"{out}/graph_blocks"))
    assert {r.node: r.color for r in nodes.collect()} == {"main.py": "#E24B4A", "core/db.py": "#E24B4A"}
    assert all(r.in_cycle for r in edges.collect())

    fitted = spark.read.parquet(f"{out}/encoder")
    assert {r.n for r in fitted.collect()} == {2}
    with pytest.raises(ValueError):
        jobs.ask(index, index.limit(0), responder)
    questions = spark.createDataFrame([(1, "alpha", "where is connect"), (2, "gamma", "anything")],
                                      "query_id long, repo_name string, question string")
    ans = {r.query_id: (r.status, r.chunks_used) for r in jobs.ask(index, questions, responder, fitted=fitted).collect()}
    assert ans == {1: ("success", 2), 2: ("not indexed", 0)}

    found = jobs.review(index, responder).collect()
    assert [(r.repo_name, r.file, r.line, r.severity) for r in found] == [("alpha", "core/db.py", 3, "high")]

    totals = {r.repo_name: (r.status, r.total) for r in jobs.review_totals(index, jobs.review(index, responder), repos).collect()}
    assert totals == {"alpha": ("success", 1), "gamma": ("not indexed", 0)}

    st = {r.repo_name: (r.indexed, r.chunks) for r in jobs.status(index, repos).collect()}
    assert st == {"alpha": (True, 2), "gamma": (False, 0)}

"""Findings of round four: whole cycles, counts without listing, components of long chains, questions to every repository."""

import pytest
from pyspark.sql import functions as F

from srcatlas import session
from srcatlas.operators import cycles

EDGES = "repo_name string, src string, dst string"


def triangles(repo, k):
    """A ring of ``k`` triangles: 2 k cycles inside them and 2 ** k around."""
    pairs = []
    for i in range(k):
        a, b, c, following = f"{i:03}a", f"{i:03}b", f"{i:03}c", f"{(i + 1) % k:03}a"
        pairs += [(repo, a, b), (repo, a, c), (repo, b, c), (repo, c, a), (repo, c, following)]
    return pairs


def test_cycles_beyond_any_number_of_visits_are_listed(spark):
    k = 16
    names, following = cycles._graph([{"src": a, "dst": b} for _, a, b in triangles("r", k)])
    assert list(cycles.walk_cycles(following, budget=250_000))[-1] is None
    found = cycles.cycles(spark.createDataFrame(triangles("r", k), EDGES))
    row = found.agg(F.count("*").alias("n"), F.countDistinct("path").alias("d"), F.every("complete").alias("whole")).first()
    assert (row.n, row.d, row.whole) == (2 * k + 2 ** k, 2 * k + 2 ** k, True)


def test_large_components_are_searched_for_cycles_of_any_length(spark):
    ring = [("ring", f"f{i:02}", f"f{(i + 1) % 12:02}") for i in range(12)]
    got = cycles.cycles(spark.createDataFrame(ring, EDGES), local_edge_limit=0).collect()
    assert [(r.length, r.complete) for r in got] == [(12, True)]


def test_counts_need_no_listing(spark):
    edges = spark.createDataFrame(triangles("many", 50) + triangles("few", 3) + triangles("beyond", 70) + [("none", "a", "b")], EDGES)
    nodes = edges.select("repo_name", F.col("src").alias("node"))
    got = {r.repo_name: (r.cycles, r.complete) for r in cycles.cycle_counts(edges, nodes).collect()}
    assert got == {"many": (100 + 2 ** 50, True), "few": (14, True), "beyond": (2 ** 63 - 1, False), "none": (0, True)}
    level = cycles.cycle_counts(edges.filter("repo_name = 'few'"), nodes, local_edge_limit=0).filter("repo_name = 'few'").first()
    assert (level.cycles, level.complete) == (14, True)


def test_counts_against_brute_force():
    import random

    from test_graph_and_store import brute_cycles

    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 8)
        edges = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 24))) if a != b})
        following = [[b for a, b in edges if a == v] for v in range(n)]
        want = brute_cycles(n, edges)
        for limit, listed in ((10 ** 6, 0), (2, 0), (2, 10 ** 6)):      # by sweep, listed after it gave up, listed at once
            assert cycles.count_cycles(following, limit, listed) == len(want)
        slices = [c for k in range(3) for c in cycles.walk_cycles(following, lambda first: first % 3 == k)]
        assert sorted(slices) == want


@pytest.mark.parametrize("named", [10 ** 6, 0])
def test_long_chains_cost_no_rounds(spark, named):
    n = 3000
    edges = [("chain", f"f{i:05}", f"f{i - 1:05}") for i in range(1, n)] + [("chain", "f00010", "f00012"), ("é", "b", "a"), ("é", "a", "b"), ("none", "x", "y")]
    session.drop_tables(spark)
    got = sorted(map(tuple, cycles.strongly_connected(spark.createDataFrame(edges, EDGES), named_edge_limit=named).collect()))
    assert got == [("chain", f"f{i:05}", "f00012") for i in (10, 11, 12)] + [("é", "a", "b"), ("é", "b", "b")]
    assert len(session._TABLES.get(spark.sparkContext.applicationId, [])) <= 3


def test_every_repository_can_be_asked(spark, tmp_path):
    from srcatlas.plans import registry

    (spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of text "), F.col("id")).alias("text"))
     .write.parquet(str(tmp_path / "documents.parquet")))
    (spark.range(6).select(F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("which text").alias("text"))
     .write.parquet(str(tmp_path / "conversations.parquet")))
    got = {r.repo_name: (r.status, r.chunks_used) for r in registry.QUERIES["asked_index"](spark, str(tmp_path)).collect()}
    assert got == {**{f"repo{i}": ("success", 5) for i in range(5)}, "repo5": ("not indexed", 0)}


def test_broadcast_bound_counts_the_hash_table(spark, monkeypatch):
    from srcatlas.operators import ordinals

    thin = spark.range(300).select(F.lit("r").alias("repo_name"), F.col("id"))
    monkeypatch.setattr(ordinals, "BROADCAST_BYTES", 300 * 40)      # the keys and 16 bytes a row would pass
    assert "strategy=broadcast" not in ordinals.travelling(thin, ["repo_name"])._jdf.queryExecution().toString()
    monkeypatch.setattr(ordinals, "BROADCAST_BYTES", 300 * 200)
    assert "strategy=broadcast" in ordinals.travelling(thin, ["repo_name"])._jdf.queryExecution().toString()


def test_vectors_that_are_used_once_are_not_stored(spark, tmp_path):
    from srcatlas.plans import registry

    (spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of text "), F.col("id")).alias("text"))
     .write.parquet(str(tmp_path / "documents.parquet")))
    session.drop_tables(spark)
    rows = registry.QUERIES["chunk_encodings"](spark, str(tmp_path))
    assert not [p for p in session._TABLES[spark.sparkContext.applicationId] if "chunk-vectors" in p]
    assert rows.count() > 100 and rows.filter("weight = 0").count() == 0

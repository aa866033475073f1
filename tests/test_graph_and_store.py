"""Graph properties, skew-safe ordinals and persistence."""

import itertools

from pyspark.sql import Window
import pytest
from pyspark.sql import functions as F

from srcatlas.operators import cycles, graph, imports, ordinals, view
from srcatlas.sources import store

EDGES = "repo_name string, src string, dst string"


def _brute_cycle_nodes(edges):
    by = {}
    for r, s, d in edges:
        by.setdefault(r, {}).setdefault(s, set()).add(d)
    out = set()
    for r, adj in by.items():
        for start in adj:
            seen, todo = set(), list(adj[start])
            while todo:
                v = todo.pop()
                if v == start:
                    out.add((r, start))
                    break
                if v not in seen:
                    seen.add(v)
                    todo.extend(adj.get(v, ()))
    return out


def test_scc_quirk_graph_and_bridge(spark):
    rows = [("r", "loop_a.py", "loop_b.py"), ("r", "loop_b.py", "loop_a.py"), ("r", "x.py", "y.py"),
            ("r", "y.py", "z.py"), ("r", "z.py", "x.py"), ("r", "loop_b.py", "x.py"), ("r", "main.py", "x.py"),
            ("s", "a", "b")]
    e = spark.createDataFrame(rows, EDGES).withColumn("first_ord", F.lit(0).cast("bigint"))
    local = {(r.repo_name, r.node) for r in cycles.strongly_connected(e).collect()}
    dist = {(r.repo_name, r.node) for r in cycles.strongly_connected(e, local_edge_limit=0).collect()}
    assert local == dist == _brute_cycle_nodes(rows)
    assert len(local) == 5
    scc = cycles.strongly_connected(e)
    assert cycles.cycles(e, scc).count() == 2
    red = {(r.src, r.dst) for r in view.edge_view(e, scc).filter("in_cycle").collect()}
    assert ("loop_b.py", "x.py") in red and ("main.py", "x.py") not in red


def test_scc_random_graphs_against_brute_force(spark):
    import random
    rnd = random.Random(3)
    rows = []
    for repo in ("p", "q"):
        n = 12
        for a, b in itertools.permutations(range(n), 2):
            if rnd.random() < 0.09:
                rows.append((repo, f"n{a:02d}", f"n{b:02d}"))
    e = spark.createDataFrame(rows, EDGES)
    local = {(r.repo_name, r.node) for r in cycles.strongly_connected(e).collect()}
    assert local == _brute_cycle_nodes(rows)


def test_group_ordinals_match_row_number_on_skewed_groups(spark):
    data = [("hot", f"f{i:05d}") for i in range(3000)] + [(f"c{i}", f"g{i}") for i in range(50)]
    df = spark.createDataFrame(data, "repo_name string, file_path string")
    got = ordinals.group_ordinals(df, ["repo_name"], ["file_path"], "o", partitions=7)
    want = df.withColumn("o", (F.row_number().over(Window.partitionBy("repo_name").orderBy("file_path")) - 1).cast("bigint"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_group_ordinals_hold_with_wide_rows_beyond_the_range_sample(spark):
    df = (spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 7)).alias("repo_name"),
                                     F.format_string("f%06d", "id").alias("file_path"), F.repeat(F.lit("x"), 50).alias("text")))
    got = ordinals.group_ordinals(df, ["repo_name"], ["file_path"], "o", partitions=32)
    want = df.withColumn("o", (F.row_number().over(Window.partitionBy("repo_name").orderBy("file_path")) - 1).cast("bigint"))
    assert got.count() == 30_000 and got.select(*want.columns).exceptAll(want).isEmpty()


def brute_search(index, queries, k):
    import numpy as np
    out = []
    for qid, qr, qv in queries:
        if None in (qid, qr, qv) or not qv or not np.isfinite(np.array(qv, float)).all():
            continue
        scored = []
        for r, i, v in index:
            if r != qr or i is None or not v or len(v) != len(qv) or not np.isfinite(np.array(v, float)).all():
                continue
            n = np.linalg.norm(v) * np.linalg.norm(qv)
            scored.append((-round(float(np.dot(v, qv) / n), 9) + 0.0 if n else 0.0, i))
        out += [(qid, r + 1, i, round(-s, 4) + 0.0) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


VECTORS = "repo_name string, chunk_id long, embedding array<float>"
ASKED = "query_id long, repo_name string, embedding array<double>"


def test_exact_search_in_blocks(spark):
    import random
    from srcatlas.operators import vectors
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["b", "c"]), i, [float(rng.randint(-4, 4)) for _ in range(3)]) for i in range(400)]
    rows += [("hot", 500 + i, [1.0, 2.0, 3.0]) for i in range(30)] + [("b", 600, None), ("b", 601, []), ("b", 602, [1.0, float("nan"), 0.0]),
             ("b", 603, [1.0, 2.0]), (None, 604, [1.0, 1.0, 1.0]), ("b", None, [1.0, 1.0, 1.0]), ("c", 605, [0.0, 0.0, 0.0]), ("b", 606, [None, 1.0, 1.0])]
    asked = [(i, rng.choice(["hot", "b", "c", "unknown"]), [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(60)]
    asked += [(100, "hot", [0.0, 0.0, 0.0]), (101, "hot", None), (102, None, [1.0, 0.0, 0.0]), (None, "hot", [1.0, 0.0, 0.0]), (103, "hot", [1.0, 2.0, 3.0])]
    index, queries = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(asked, ASKED)
    plain = [(r, i, None if v is None or None in v else v) for r, i, v in rows]
    for cells in (1 << 18, 60):                  # one block a repository, or very many
        got = vectors.search(index, queries, top_k=4, block_cells=cells).select("query_id", "rank", "chunk_id", "score").collect()
        assert sorted((r[0], r[1], r[2], r[3] + 0.0) for r in got) == brute_search(plain, asked, 4)
    payload = vectors.search(index.withColumn("text", F.lit("t")), queries, top_k=1)
    assert set(payload.columns) == {"query_id", "repo_name", "chunk_id", "rank", "score", "text"}
    assert vectors.search(index.limit(0), queries).count() == 0 == vectors.search(index, queries.limit(0)).count()


def test_approximate_search_defines_zero_and_null_vectors(spark):
    from srcatlas.operators import vectors
    index = spark.createDataFrame([(r, i, [1.0, float(i)]) for r in ("a", "b") for i in range(3)] + [("a", 7, [0.0, 0.0]), ("a", 8, None)], VECTORS)
    queries = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "a", None), (4, "none", [1.0, 0.0])], ASKED)
    got = vectors.search_approx(index, queries, top_k=5).collect()
    assert {(r.query_id, r.repo_name) for r in got} == {(1, "a"), (2, "a")} and {r.chunk_id for r in got} == {0, 1, 2, 7}
    assert {r.score for r in got if r.query_id == 2} == {0.0}


def test_encoder_statistics_are_fitted_once(spark, tmp_path):
    import math
    from srcatlas.operators import vectors
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "Alpha, gamma"), (3, None), (4, "  ")], "i int, text string")
    fitted = vectors.fit_encoder(docs, str(tmp_path / "enc"), dim=4096)
    again = spark.read.parquet(str(tmp_path / "enc"))
    assert sorted(r.df for r in again.collect()) == [1, 1, 2] and {r.n for r in again.collect()} == {4}
    got = {r.i: [x for x in r.embedding if x] for r in vectors.encode(docs, fitted, dim=4096).collect()}
    common, rare = math.log(5 / 3) + 1, 2 * (math.log(5 / 2) + 1)
    norm = math.hypot(common, rare)
    assert sorted(got[1]) == [pytest.approx(common / norm), pytest.approx(rare / norm)] and got[3] == got[4] == []
    asked = vectors.encode(spark.createDataFrame([("never seen",)], "text string"), fitted, dim=4096).first().embedding
    assert sorted(x for x in asked if x) == [pytest.approx(2 ** -0.5)] * 2


def test_user_encoder_runs_and_leaves_the_input_schema_alone(spark):
    from srcatlas.operators import vectors
    df = spark.createDataFrame([("ab",), (None,)], "text string")
    got = vectors.embed(df, encoder=lambda texts: [[float(len(t))] for t in texts])
    assert sorted(r.embedding[0] for r in got.collect()) == [0.0, 2.0] and df.columns == ["text"]


def test_normpath(spark):
    cases = {"a/./b/../c": "a/c", "api/routes/../../core/m5": "core/m5", "./m": "m", "../x": "../x",
             "a/..": ".", "a//b/": "a/b"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.n for r in df.select("p", imports.normpath(F.col("p")).alias("n")).collect()}
    assert got == cases


def test_write_chunk_index_replaces_only_written_repos(spark, tmp_path):
    path = str(tmp_path / "idx")
    schema = "repo_name string, chunk_id bigint, text string"
    store.write_chunk_index(spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], schema), path)
    store.write_chunk_index(spark.createDataFrame([("a", 0, "new")], schema), path)
    store.write_chunk_index(spark.createDataFrame([("a", 0, "new")], schema), path)   # idempotent
    got = sorted((r.repo_name, r.chunk_id, r.text) for r in store.read_chunk_index(spark, path).collect())
    assert got == [("a", 0, "new"), ("b", 0, "z")]


def test_index_admission(spark):
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0)], "repo_name string, chunk_id bigint")
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo_name string")
    got = {r.repo_name: (r.n_chunks, r.status) for r in store.index_admission(chunks, repos, 2).collect()}
    assert got == {"a": (3, "error"), "b": (1, "success"), "c": (0, "error")}


def test_pack_unpack_roundtrip(spark):
    nodes = spark.createDataFrame([("r", "a", "python", 1), ("r", "b", "python", 1), ("r", "lonely", "python", 1)],
                                  "repo_name string, node string, language string, size int")
    edges = spark.createDataFrame([("r", "a", "b", 0)], "repo_name string, src string, dst string, first_ord bigint")
    n2, e2 = graph.unpack_graph(graph.pack_graph(nodes, edges))
    assert sorted(r.node for r in n2.collect()) == ["a", "b", "lonely"]
    assert [(r.src, r.dst) for r in e2.collect()] == [("a", "b")]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_graph_blocks_round_trip(spark, block):
    nodes = spark.createDataFrame([("r", f"f{i:02}", "python", 1) for i in range(11)] + [("one", "x", "python", 1), ("none", "y", "python", 1)],
                                  "repo_name string, node string, language string, size long")
    pairs = [("r", f"f{i:02}", f"f{j:02}", (i * j) % 7) for i in range(11) for j in range(11) if i != j and (i * j) % 3 == 1] + [("r", "gone", "f01", 0)]
    edges = spark.createDataFrame(pairs, "repo_name string, src string, dst string, first_ord long").withColumn("weight", F.lit(1))
    stored = graph.graph_blocks(nodes, edges, block)
    assert max(len(r.nodes) for r in stored.collect()) <= block
    back_nodes, back = graph.from_blocks(stored, block)
    assert sorted((r.repo_name, r.node) for r in back_nodes.collect()) == sorted((r.repo_name, r.node) for r in nodes.collect())
    want, known = [], [p for p in pairs if p[1] != "gone"]
    for src in {p[1] for p in known}:
        ordered = sorted((p[3], p[2]) for p in known if p[1] == src)
        want += [("r", src, dst, i, 1) for i, (_, dst) in enumerate(ordered)]
    assert sorted(map(tuple, back.collect())) == sorted(want)


def test_last_update_of_a_batch_wins(spark, tmp_path):
    rows = spark.createDataFrame([("a", "old", 1), ("a", "new", 3), ("a", "mid", 2)],
                                 "repo_name string, summary string, seq int")
    store.upsert_metadata(spark, str(tmp_path / "m"), rows, order="seq")
    assert [r.summary for r in spark.read.parquet(str(tmp_path / "m")).collect()] == ["new"]


def test_listing_finds_cycles_of_any_length(spark):
    ring = [("ring", f"f{i:02}", f"f{(i + 1) % 11:02}") for i in range(11)]
    full = [("full", f"g{i}", f"g{j}") for i in range(6) for j in range(6) if i != j]
    both = [("both", "a", "b"), ("both", "b", "a")] + [("both", f"x{i}", f"x{(i + 1) % 9}") for i in range(9)]
    e = spark.createDataFrame(ring + full + both, "repo_name string, src string, dst string")
    got = [tuple(r) for r in cycles.show_cycles(cycles.first_cycles(e), 5).orderBy("repo_name", "rank").collect()]
    every = [tuple(r) for r in cycles.show_cycles(cycles.cycles(e), 5).orderBy("repo_name", "rank").collect()]
    assert got == every and [g[:2] for g in got] == [("both", 1), ("both", 2)] + [("full", k) for k in range(1, 6)] + [("ring", 1)]


def test_hot_module_is_ranked_before_its_importers(spark):
    import time
    n, m = 10_000, 1_000
    files = spark.createDataFrame([("r", f"d{i}/utils.py") for i in range(m)] + [("r", "p/other/__init__.py"), ("r", "other.js")],
                                  "repo_name string, rel_path string")
    imps = spark.createDataFrame([("r", f"d{i % (2 * m)}/f{i}.py", "python", "utils") for i in range(n)] + [("r", "x.py", "python", "other")],
                                 "repo_name string, src string, language string, import_path string")
    started = time.time()
    got = {r.src: r.dst for r in imports.resolve_python_imports(imps, files).collect()}
    assert len(got) == n + 1 and got["x.py"] == "p/other/__init__.py"
    for i in (0, 7, 999, 1000, 1999, 9999):
        d = i % (2 * m)
        assert got[f"d{d}/f{i}.py"] == (f"d{d}/utils.py" if d < m else "d0/utils.py")
    assert time.time() - started < 60


def brute_cycles(n, edges):
    following = {v: [b for a, b in edges if a == v] for v in range(n)}
    out = []

    def walk(path):
        for w in following[path[-1]]:
            if w == path[0]:
                out.append(path)
            elif w > path[0] and w not in path:
                walk([*path, w])

    for v in range(n):
        walk([v])
    return sorted(out)


def test_elementary_cycles_against_brute_force():
    import random
    from srcatlas.operators import cycles
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 9)
        edges = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 24))) if a != b})
        following = [[b for a, b in edges if a == v] for v in range(n)]
        found, whole = cycles.elementary_cycles(following, 10 ** 6)
        assert whole and sorted(found) == brute_cycles(n, edges)
    ring = [[(i + 1) % 12] for i in range(12)]
    assert cycles.elementary_cycles(ring, 10 ** 6) == ([list(range(12))], True)
    full = [[j for j in range(14) if j != i] for i in range(14)]
    found, whole = cycles.elementary_cycles(full, 5_000)
    assert not whole and 100 < len(found) <= 5_000


def test_cycles_carry_whether_they_are_all(spark):
    from srcatlas.operators import cycles
    ring = [("ring", f"f{i:02}", f"f{(i + 1) % 12:02}") for i in range(12)]
    full = [("full", f"g{i}", f"g{j}") for i in range(6) for j in range(6) if i != j]
    edges = spark.createDataFrame(ring + full, "repo_name string, src string, dst string")
    got = {r.repo_name: (r["n"], r.longest, r.whole) for r in cycles.cycles(edges).groupBy("repo_name").agg(
        F.count("*").alias("n"), F.max("length").alias("longest"), F.every("complete").alias("whole")).collect()}
    assert got == {"ring": (1, 12, True), "full": (409, 6, True)}
    short = {r.repo_name: r.whole for r in cycles.cycles(edges, budget=200).groupBy("repo_name").agg(F.every("complete").alias("whole")).collect()}
    assert short == {"ring": True, "full": False}
    level = cycles.cycles(edges, local_edge_limit=0, max_len=6).groupBy("repo_name").agg(F.count("*").alias("n"), F.every("complete").alias("whole"))
    assert {r.repo_name: (r["n"], r.whole) for r in level.collect()} == {"full": (409, True)}


def test_drop_tables_deletes_what_was_written(spark):
    import os
    from srcatlas import session
    from srcatlas.operators import cycles
    session.drop_tables(spark)
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a")], "repo_name string, src string, dst string")
    assert cycles.strongly_connected(edges, local_edge_limit=0).count() == 2        # the distributed rounds
    written = [p.removeprefix("file://") for p in session._TABLES[spark.sparkContext.applicationId]]
    assert len(written) > 3 and all(map(os.path.isdir, written))
    assert session.drop_tables(spark) == len(written) and not any(map(os.path.isdir, written))

"""Golden tests on the hand-written mini corpus (one row per quirk of the reference)."""

from pyspark.sql import functions as F

from srcatlas.functions import paths as P
from srcatlas.operators import chunk, graph, imports, rank, replies, select

SCHEMA = "repo_name string, rel_path string, content string, size bigint"


def files_df(spark, rows):
    return spark.createDataFrame([(r, p, c, len(c.encode()) if s is None else s) for r, p, c, s in rows], SCHEMA)


def test_selection_quirks(spark):
    rows = [("r", p, "x = 1\n", s) for p, s in [
        ("src/empty.py", 0), ("src/big.py", 50_001), ("src/limit.py", 50_000), ("auth.test.js", None),
        ("Test_X.py", None), ("auth.test.tsx", None), (".py", None), ("node_modules/a.js", None),
        (".cache/b.py", None), ("a/.hidden/c.py", None), ("m.min.js", None), ("setup.py", None),
        ("ok/main.py", None), ("web/x.jsx", None)]]
    got = {r.rel_path: r.language for r in select.select_sources(files_df(spark, rows)).collect()}
    assert got == {"src/limit.py": "python", "auth.test.tsx": "typescript", "ok/main.py": "python",
                   "web/x.jsx": "javascript"}


def test_url_functions(spark):
    urls = ["https://github.com/o/r", "https://github.com/o/r.git", "https://github.com/o/r/",
            "https://github.com/o/r.git/", "http://github.com/o/r", "https://gitlab.com/o/r", "https://github.com/o"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    out = df.select(P.is_repo_url("url").alias("ok"), P.repo_of_url("url").alias("repo"),
                    P.owner_of_url("url").alias("owner")).collect()
    assert [r.ok for r in out] == [True, True, True, True, True, False, False]
    assert [r.repo for r in out[:5]] == ["r"] * 5 and [r.owner for r in out[:5]] == ["o"] * 5


def test_chunk_order_sizes_and_fallback(spark):
    k = ("class K:\n    def method_one(self, a, b):\n        return a + b + 1000000000000000000\n\n"
         "    def s(self):\n        return 1\n")
    two = ("def first(x):\n    return x + 11111111111111111111111111111111111\n\n"
           "def second(y):\n    return y + 22222222222222222222222222222222222\n")
    long_body = "def big():\n" + "".join(f"    v{i} = {i}\n" for i in range(400))
    script = "".join(f"statement_number_{i} = {i}\n" for i in range(1, 102))
    rows = [("r", p, c, None) for p, c in [("k.py", k), ("two.py", two), ("long.py", long_body), ("script.py", script)]]
    sel = select.select_sources(files_df(spark, rows))
    out = chunk.chunk_files(sel).orderBy("chunk_id").collect()
    ids = [(r.file_path, r.name) for r in out]
    assert ids[:2] == [("k.py", "K"), ("k.py", "method_one")]          # class before its method; short one dropped
    assert [n for f, n in ids if f == "two.py"] == ["second", "first"]  # later span first
    big = [r for r in out if r.file_path == "long.py"][0]
    assert big.text.endswith("\n... [truncated]") and len(big.text) == 3016 and big.end_line == 401
    raw = [(r.name, r.start_line, r.end_line) for r in out if r.file_path == "script.py"]
    assert raw == [("lines_1_50", 1, 50), ("lines_51_100", 51, 100)]   # line 101 is < 50 chars
    assert [r.chunk_id for r in out] == list(range(len(out)))


def test_import_resolution(spark):
    rows = [("r", p, c, None) for p, c in [
        ("main.py", "import core.db\nfrom api import routes\n"), ("core/db.py", "from . import x\n"),
        ("api/__init__.py", "X = 1\n"), ("core/a.py", "import config\n"), ("core/config.py", "A = 1\n"),
        ("config.py", "B = 1\n"), ("lib/videos.py", "V = 1\n"), ("tool.py", "import os\n"),
        ("web/a.ts", "import {b} from './b'\nexport * from './c'\nconst d = import('./d')\nrequire('./e')\n"),
        ("web/b/index.tsx", "x\n"), ("web/b.js", "y\n"), ("web/e.ts", "z\n"),
        ("frontend/src/ui/x.tsx", "w\n"), ("frontend/src/app.ts", "import x from '@/ui/x'\n")]]
    sel = select.select_sources(files_df(spark, rows))
    imps = imports.extract_imports(sel)
    res = {(r.src, r.import_path): r.dst for r in imports.resolve_imports(imps, sel).collect()}
    assert res[("main.py", "core.db")] == "core/db.py"
    assert res[("main.py", "api")] == "api/__init__.py"
    assert res[("core/a.py", "config")] == "core/config.py"           # same directory wins
    assert res[("tool.py", "os")] == "lib/videos.py"                  # unaligned suffix
    assert res[("web/a.ts", "./b")] == "web/b.js" and res[("web/a.ts", "./e")] == "web/e.ts"
    assert res[("frontend/src/app.ts", "@/ui/x")] == "frontend/src/ui/x.tsx"
    assert ("web/a.ts", "./c") not in res and ("web/a.ts", "./d") not in res
    aligned = {(r.src, r.import_path) for r in imports.resolve_python_imports(imps, sel, segment_aligned=True).collect()}
    assert ("tool.py", "os") not in aligned


def test_degrees_sum(spark):
    rows = [("r", "a.py", "import b\nimport c\n", None), ("r", "b.py", "import c\n", None), ("r", "c.py", "import a\n", None)]
    sel = select.select_sources(files_df(spark, rows))
    imps = imports.extract_imports(sel)
    edges = graph.graph_edges(imports.resolve_imports(imps, sel), imps)
    deg = graph.degrees(graph.graph_nodes(sel), edges).collect()
    assert sum(r.in_degree for r in deg) == sum(r.out_degree for r in deg) == edges.count() == 4


def test_file_score(spark):
    df = spark.createDataFrame([("api/router.py",), ("core/config.py",), ("eslint.config.js",)], "p string")
    assert [r.s for r in df.select(rank.file_score("p").alias("s")).collect()] == [60, 135, -85]


def test_replies(spark):
    rows = [(1, "r", "[]"), (2, "r", 'Here: [{"file":"a.py","line":"34","severity":"high","issue":"i","suggestion":"s"}] done'),
            (3, "r", '[{"line":3.7},{"line":null},{"line":"x"},5,{"file":null}]'), (4, "r", '{"file":"a.py"}'),
            (5, "r", "[LLM Error] x")]
    df = spark.createDataFrame(rows, "request_id long, repo_name string, reply string")
    got = sorted((r.request_id, r.file, r.line) for r in replies.findings(df).collect())
    assert got == [(2, "a.py", 34), (3, "None", 0), (3, "unknown", 3)]
    arch = spark.createDataFrame([(1, "S\n```mermaid\nflowchart TD\nA-->B\n```"), (2, "only text"),
                                  (3, "t ```mermaid\nA"), (4, "[LLM Error] x")], "request_id long, reply string")
    out = {r.request_id: (r.summary, r.mermaid, r.saved) for r in replies.architecture_results(arch).collect()}
    assert out[1] == ("S", "flowchart TD\nA-->B", True)
    assert out[2][1] == replies.MISSING_DIAGRAM and out[3][1] == replies.MISSING_DIAGRAM
    assert out[4] == (replies.FAILED_SUMMARY, replies.FAILED_DIAGRAM, False)


def test_infer_errors_are_values(spark):
    def responder(prompt, temperature):
        if "boom" in prompt:
            raise ValueError("boom")
        return f"echo {temperature}"
    df = spark.createDataFrame([(1, "hi", 0.3), (2, "boom", 0.1)], "request_id long, prompt string, temperature double")
    out = {r.request_id: (r.reply, r.is_error) for r in replies.infer(df, responder).collect()}
    assert out[1] == ("echo 0.3", False) and out[2][1] and out[2][0].startswith("[LLM Error]")


def test_infer_passes_message_and_budget(spark):
    def responder(prompt, temperature, system, max_tokens):
        return f"{system}/{max_tokens}/{prompt}"
    df = spark.createDataFrame([(1, "hi", 0.3)], "request_id long, prompt string, temperature double")
    assert replies.infer(df, responder, system="s", max_tokens=7).first().reply == "s/7/hi"


def test_findings_keep_the_last_of_repeated_keys(spark):
    df = spark.createDataFrame([(1, "r", '[{"file": "a", "file": "b", "line": 2}]')],
                               "request_id long, repo_name string, reply string")
    assert [(r.file, r.line) for r in replies.findings(df).collect()] == [("b", 2)]


def test_findings_keep_every_integer_line(spark):
    lines = ["99999999999", "3000000000", '"1_0"', '" 7 "', "true", "1e3", "-5", '"3.5"', "NaN", "1e999", "[1]", "1" + "0" * 30]
    reply = "[" + ", ".join(f'{{"line": {x}, "issue": "{i}"}}' for i, x in enumerate(lines)) + "]"
    df = spark.createDataFrame([(1, "r", reply), (2, "r", None), (3, "r", "]["), (4, "r", "[{]")], "request_id long, repo_name string, reply string")
    got = {int(r.issue): r.line for r in replies.findings(df).collect()}
    assert got == {0: 99999999999, 1: 3000000000, 2: 10, 3: 7, 4: 1, 5: 1000, 6: -5, 11: 2 ** 63 - 1}

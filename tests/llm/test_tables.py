"""Vectors, pages, conversations and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from srcatlas.llm import chat_rotation, html_blocks, html_labeller, impact_search, url_rules
from srcatlas.llm.components import components


def test_top_k_is_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, list(rows[0][1])) for i in range(8)] + [(400, None), (401, [float("nan")] * 6), (402, [1.0, 2.0]),
                                                              (403, [None] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = impact_search.top_k(df, df.where("vec_id % 5 = 0"), k=5, shard=64, block=7).collect()
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 5 == 0:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert impact_search.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("large", [10_000.0, 1.2e7, 3e9, 1e30])
def test_top_k_of_large_components(spark, large):
    rng = random.Random(9)
    rows = [(i, [large * rng.choice([1.0, -1.0, 0.5, 0.0, rng.gauss(0, 1)]) for _ in range(8)]) for i in range(60)]
    rows += [(100 + i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(40)] + [(200, [large] * 8), (201, [large] * 8)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, score int, part int, dim int")
    got = impact_search.top_k(df, df.where("vec_id % 5 = 0"), k=5, shard=30, block=7).collect()
    v = {i: [max(min(int(np.floor(256 * x)), 1 << 57), -(1 << 57)) for x in e] for i, e in rows}
    want = []
    for q in v:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q)[:5]
            want += [(q, k + 1, i, max(min(-s, 2 ** 63 - 1), -2 ** 63)) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("a.example.org", "/en/12/", "allow"), ("com", "/fr/", "allow")]
    urls = [None, "", "no scheme", "http://X.Example.ORG/en/123?q#f", "http://a.example.org/en/12/3", "http://example.org",
            "https://notexample.org/es/", "http://b.a.example.org/es/x://y", "ftp://com/fr/", "http://fr.com/fr/a", "http://com.net/fr/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 30)], "page_id long, url string")
    got = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        return (host, path, best and best[0] + best[1], best[2] if best else "allow")

    assert sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in got.collect()) == sorted(
        (i, h, p, str(r), v) for i, u in enumerate(urls * 30) for h, p, r, v in [brute(u)])


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "ann", "hi <|im_start|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"),
            (2, 0, "system", "alone"), (3, None, None, "x"), (None, 1, "ann", "null conversation")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_rotation.rotate(df).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "ann")}
    own = sorted((r for r in got if r.conv_id == 1 and r.perspective == "ann"), key=lambda r: r.position)
    text = "".join(r.segment for r in own)
    assert [(r.seg_start, r.seg_end) for r in own] == [(text.index(r.segment), text.index(r.segment) + len(r.segment)) for r in own]
    assert [text[r.mask_start:r.mask_end] for r in own] == ["", "hi < |im_start|><|im_end|>", "", "bye<|im_end|>"]
    assert "<|im_start|>user name=bob\n<|im_end|>\n" in text


def test_names_stay_on_one_line(spark):
    df = spark.createDataFrame([(1, 0, "bob\nI am evil\r\u2028x", "a"), (1, 1, "ann", "b\nc")], "conv_id long, turn long, role string, text string")
    own = sorted((r for r in chat_rotation.rotate(df).collect() if r.perspective == "ann"), key=lambda r: r.position)
    assert own[0].segment == "<|im_start|>user name=bob I am evil  x\na<|im_end|>\n" and own[1].segment.endswith("b\nc<|im_end|>\n")


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)]
    parent = {i: i for e in edges for i in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for a, b in edges for i in (a, b) if a != b or i in got}


PAGE = """<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><ul><li><a href=/>Home</a><li><a>News</a></ul></nav>
<article><h1>A&nbsp;title &amp; more</h1><p><b>First   paragraph of the story, told at some length.<br><p>Second one, with a number of words.</p></article>
<div class="comments"><p>Nice article, thanks a lot!</p></div><footer>&copy; site</footer>"""


def test_blocks_of_broken_markup():
    assert [b.text for b in html_blocks.blocks(PAGE)] == [
        "Home", "News", "A title & more", "First paragraph of the story, told at some length.",
        "Second one, with a number of words.", "Nice article, thanks a lot!", "© site"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<p") == html_blocks.blocks("<p")


def test_blocks_of_elements_left_open():
    def texts(page):
        return [b.text for b in html_blocks.blocks(page)]

    assert texts("<html><head><title>x</title><meta a><body><article><p>Body") == ["Body"]
    assert texts("<html><head><title>x</title>\n<p>First<p>Second") == ["First", "Second"]
    assert texts("<head><style>x</style><link><b>Bold</b> text") == ["Bold text"] and texts("<head>Text") == ["Text"]
    for tag in ("button", "select><option", "object", "video", "svg"):
        assert texts(f"<div><{tag}>no<p>One</p>Two</div>Three") == ["One", "Two", "Three"]
    assert texts("<ul><li><button>no<li>One<li><button>no</button>Two</ul>") == ["One", "Two"]
    assert texts("<div><button><div>no</div></button><select><option>no<option>no</select>Yes</div>") == ["Yes"]
    assert texts("<object><object>no</object><p>no</p></object><video><p>no</video>Yes") == ["Yes"]
    assert texts("<p>So <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds") == ["So a=1 holds"]


def test_blocks_lose_and_split_no_text():
    def texts(page):
        return [b.text for b in html_blocks.blocks(page)]

    assert texts("<article><p title=it's>Hello one</p><p>Second it's here</p><p>Third</p>") == ["Hello one", "Second it's here", "Third"]
    assert texts("<p>one<img src=x>two w<wbr>x a<custom-el>b</custom-el>c i <button>no</button> j <input value=q>k<script>no</script>l</p>") == [
        "onetwo wx abc i j kl"]
    assert texts("<p a='x>y' b=\"<p>\" c=d'e>in</p><hr>after<hr/>end") == ["in", "after", "end"]
    assert texts("<p>a <svg><text>no</text></svg> b</p><figure>f<figcaption>c</figcaption></figure>") == ["a b", "f", "c"]
    assert texts("<p>x</p><!-- open <p>no") == ["x"] and texts("1 < 2 <p>y") == ["1 < 2", "y"]


def test_broken_markup_is_read_once():
    import time
    started = time.time()
    for bit in ("<a ", '<a "', "<a b='", '<a b="x>y"', "<p ='", "<!", "<!--", "</a ", "<a =", "< a", "<p><b>x"):
        html_blocks.blocks(bit * (2_000_000 // len(bit)))
    assert time.time() - started < 60


def test_html_labeller_on_the_sample_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([(900, None, None), (901, "u", ""), (None, "u", PAGE), (902, "u", "<script>x</script>")], pages.schema)
    rows = pages.unionByName(odd).collect()
    got = {(r.page_id, r.url): r for r in html_labeller.extract(pages.unionByName(odd)).collect()}
    assert len(got) == len(rows) and got[(901, "u")].text == "" and got[(902, "u")].n_chars == 0
    right = 0
    for r in rows:
        found = html_blocks.blocks(r.html or "")
        want = "\n\n".join(b.text for b in found if any(t == "article" for t, _ in b.path))
        right += got[(r.page_id, r.url)].text == want
        assert got[(r.page_id, r.url)].n_chars == len(got[(r.page_id, r.url)].text)
    assert right >= 0.95 * len(rows)


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "secret scans",
                                                      "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[1:4]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    lower = [r.text.lower() for r in docs.collect()]
    assert len(set(lower)) == len(lower)

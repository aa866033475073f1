"""Source mixing, hard negatives and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcatlas.llm import hard_negatives, registry, source_mixing, word_runs

DOCS = "doc_id long, text string, source string, size string, copy int, row string, weight string"


def documents(spark, rows):
    """Documents of (id, text, source) with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "s", 1, "r", "w") for r in rows], DOCS)


def level_of(sizes, weights, share=1.5, most=2.0):
    """Targets by raising every source to its cap until no other passes it, in exact fractions."""
    from fractions import Fraction as Q

    left, open_, out = Q(share) * sum(sizes.values()), dict(weights), {}
    while open_:
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > Q(most) * sizes[s]]
        if not over:
            return {**out, **{s: left * open_[s] / sum(open_.values()) for s in open_}}
        for s in over:
            out[s] = Q(most) * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def mixed_rows():
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([1, 7, 40])), rng.choice(["hot"] * 6 + ["b", "é", "", None, "Z"])) for i in range(1500)]
    return rows + [(9000, None, "b"), (9001, "", "b"), (9002, " \t\x0b x\n", "nul"), (None, "one two", "b"),
                   (None, "three", "b"), (9003, "long " * 50_000, "long"), (9004, None, "nothing"), (9005, "a b", "b"), (9005, "a b", "b")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_source_mixing(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(source_mixing, "FEW_SOURCES", 0)
    rows = mixed_rows()
    got = source_mixing.assign(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    order = sorted((s for s in size if s is not None), key=str.encode) + [None]
    want = level_of(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for r in got:
        s, n = r.row.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.row.text or ""))
        assert (r["size"], r.source_size) == (n, size[s]) and r.target == pytest.approx(float(want[s]))
        seed = hashlib.md5(f"mix:{'null' if r.row.doc_id is None else r.row.doc_id}:{r.row.text or ''}".encode()).hexdigest()
        rate = float(want[s]) / size[s] if size[s] else 0.0
        assert r.copies == int(rate) + (int(seed[:13], 16) / 2 ** 52 < rate - int(rate)) <= 2
    taken = sum(r["size"] * r.copies for r in got if r.row.source == "hot")
    assert taken == pytest.approx(float(want["hot"]), rel=0.15)


def test_mix_emits_the_copies(spark):
    docs = documents(spark, mixed_rows())
    plan = {(r.row.doc_id, r.row.text): r.copies for r in source_mixing.assign(docs).collect()}
    out = source_mixing.mix(docs)
    assert set(out.columns) == set(docs.columns) and out.where("copy < 1 or row != 'r'").count() == 0
    by = {(r.doc_id, r.text): r["count"] for r in out.groupBy("doc_id", "text").count().collect()}
    twice = (9005, "a b")
    assert by == {k: n * (2 if k == twice else 1) for k, n in plan.items() if n}


def test_mixing_nothing(spark):
    assert source_mixing.assign(documents(spark, []).limit(0)).count() == 0
    none = source_mixing.assign(documents(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r["size"], r.target, r.copies) for r in none] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (64, 64, 64), (65, 64, 129), (100, 37, 211)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(0)
    m, k, n = shape
    a, b = rng.integers(-2 ** 28, 2 ** 28, (m, k)), rng.integers(-2 ** 28, 2 ** 28, (k, n))
    assert (hard_negatives.strassen(a, b, leaf=4) == a @ b).all()
    wide = hard_negatives.strassen(a.astype(object) << 80, b.astype(object), leaf=4)
    assert (wide == (a.astype(object) << 80) @ b.astype(object)).all()


def mined(rows, anchor, k=5):
    v = [(i, lab, [int(np.floor(256 * x)) for x in x_]) for i, lab, x_ in rows if i is not None and lab is not None and x_
         and all(x is not None and np.isfinite(x) for x in x_)]
    out = set()
    for a in {(i, lab, tuple(x)) for i, lab, x in v if anchor(i)}:
        scored = [(-sum(p * q for p, q in zip(a[2], x)), i, lab) for i, lab, x in v if i != a[0] and len(x) == len(a[2])]
        for place, (p, pos, _) in enumerate(sorted(s for s in scored if s[2] == a[1])[:5]):
            hard = sorted(s for s in scored if s[2] != a[1] and 80 * -p <= 100 * -s[0] <= 100 * -p)[:k]
            out |= {(a[0], pos, place + 1, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(hard)}
    return out


VECTORS = "vec_id long, label int, embedding array<double>, anchor string, place int, score double, part int"


@pytest.mark.parametrize("scale", [1.0, 2.0 ** 21, 2.0 ** 40])
def test_hard_negatives(spark, scale):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [scale * rng.choice([rng.gauss(0.5, 1), 0.5]) for _ in range(5)]) for i in range(260)]
    rows += [(400 + i, i % 3, rows[10][2]) for i in range(30)]                       # ties
    rows += [rows[20], rows[21], (500, 7, rows[3][2]), (None, 1, rows[3][2]), (501, None, rows[3][2]), (502, 1, None), (503, 1, []),
             (504, 1, [float("inf")] * 5), (505, 1, [None] * 5), (506, 1, [1.0, 2.0]), (510, 1, [1.0, 1.0]), (507, 2, [1.0, 1.9])]
    df = spark.createDataFrame([(*r, "x", 1, 1.0, 0) for r in rows], VECTORS)
    got = hard_negatives.mine(df, df.where("vec_id % 10 = 0"), tile=300, block=40).collect()
    def as_long(x):
        return min(max(x, -2 ** 63), 2 ** 63 - 1)

    # equal positives that come from repeated rows are told apart by their rank; large scores end at a long's range
    want = {(*r[:5], as_long(r[5]), as_long(r[6])) for r in mined(rows, lambda i: i % 10 == 0)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, [1.0])], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.mine(df.limit(0), df.limit(0)).count() == 0
    assert hard_negatives.mine(df, df).count() == 0 and hard_negatives.mine(df, df.limit(0)).count() == 0


def brute_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if size >= max(least, 2 * q) and not any(all(w[x] == w[x - p] for x in range(s + p, s + size)) for p in range(1, q)):
                out.append((s, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(400):
        w = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 70))]
        if len(w) > 20 and rng.random() < 0.6:
            a, p = rng.randrange(len(w) // 2), rng.randint(1, 9)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        for least in (2, 12):
            assert word_runs.runs_of(w, least) == brute_runs(w, least)


def texts():
    rng = random.Random(8)
    out = [None, "", " \n", "one", "Ab ab " * 20, "é x\t\v y " * 9, "a " * 4000]
    for _ in range(120):
        w = [rng.choice(["a", "b", "ccc", "dé"]) for _ in range(rng.randint(1, 90))]
        out.append(rng.choice([" ", "\n", " \t "]).join(w * rng.choice([1, 1, 3])) + rng.choice(["", " "]))
    long = [f"w{rng.randint(0, 900)}" for _ in range(30_000)]
    return out + [" ".join(long + long[-7000:] + long[-7000:])]


def expected(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = brute_runs(w) if len(w) < 20_000 else None
    return w, runs


def test_runs_and_collapsed_texts(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(4, rows[4][1]), (None, rows[4][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, collapsed string")
    got = word_runs.find_runs(df)
    assert got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    for i, t in rows:
        w, runs = expected(t)
        found = [tuple(x) for x in by[i].runs]
        if runs is None:
            runs = [(len(w) - 21_000, 21_000, 7000)]
        assert found == runs
        lost = {x for s, size, q in runs for x in range(s + q, s + size)}
        assert by[i].collapsed == " ".join(x for k, x in enumerate(w) if k not in lost)
    assert word_runs.find_runs(df.limit(0)).count() == 0


def test_stretches_keep_every_run_across_documents():
    rng = random.Random(2)
    docs = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    raw = [d.encode() for d in docs]
    ends = np.append(0, np.cumsum([len(r) for r in raw]))
    runs, text, at = word_runs._work(np.frombuffer(b"".join(raw), np.uint8), ends, 12)
    assert [sorted(r) for r in runs] == [sorted(brute_runs(d.split())) for d in docs]
    assert at[-1] == len(text)


def test_run_query_on_planted_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 300)))) for i in range(150)] + [(None, "x " * 13), (7000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in word_runs.digest(word_runs.find_runs(registry.planted_repeats(docs))).collect()}
    planted = 0
    for i, t in rows:
        w = (t or "").split()
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len((t or "").split())
        if h % 10 == 0 and n:
            a, g = (h // 10) % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
            planted += 1
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        lost = {x for s, size, q in runs for x in range(s + q, s + size)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in lost).encode()).hexdigest()
    assert planted > 5


def test_word_count_is_the_regular_expression(spark):
    odd = ["", "a", " a", "a ", "   x", "a\x0bb\x0cc\rd\ne\tf", "x" * 1000 + " " * 1000, "xx x x", "\x1c \x85 b"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", source_mixing.n_words(F.col("t")).alias("n"))
    assert {r.i: r.n for r in got.collect()} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in enumerate(odd)}

"""The corpus pipeline on planted documents: every stage's rows against an independent result, and run() as a whole."""

import random

import pytest

import corpus_pipeline
from srcatlas.session import materialize

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SECRET = "password=hunter2secret99"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """(folder, rows by id, what was planted): clean, toxic, copied and near-copied documents, and one with a secret."""
    rng = random.Random(4)
    common = [f"word{i}" for i in range(400)]
    vile = [f"vile{i}" for i in range(12)]

    def prose(n=60):
        return " ".join(rng.choice(common) for _ in range(n))

    def toxic():
        w = prose(40).split()
        for i in range(0, len(w), 3):
            w[i] = rng.choice(vile)
        return " ".join(w)

    rows = {i: prose() for i in range(150)}
    bad = list(range(200, 260))
    rows |= {i: toxic() for i in bad}
    copies = {300: 3, 301: 3, 302: 10}
    rows |= {i: rows[j].upper() if i == 301 else rows[j] for i, j in copies.items()}
    near = {310: 20, 311: 20, 312: 31}
    rows |= {i: rows[j] + f" extra{i}" for i, j in near.items()}
    rows |= {320: f"{prose(20)} {SECRET} {prose(20)}", 321: "", 322: None}
    folder = str(tmp_path_factory.mktemp("planted"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i in bad)) for i in [*range(100), *bad]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, bad


def shingles(text):
    w = (text or "").translate(LOW).split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_every_stage_and_run(spark, planted):
    folder, rows, bad = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = materialize(stage(spark, docs, folder), "stage")
        assert after.columns == docs.columns, name
        kept.append({r.doc_id: r.text for r in after.collect()})
        docs = after
    clean, unique, apart, masked = kept

    # toxicity: what was planted goes, held-out documents too, and nothing else
    assert set(clean) == set(rows) - set(bad) and all(clean[i] == rows[i] for i in clean)

    groups = {}
    for i, t in clean.items():
        groups.setdefault((t or "").translate(LOW), []).append(i)
    assert set(unique) == {max(g) for g in groups.values()}

    sets = {i: shingles(t) for i, t in unique.items()}
    gone = {j for i in sets for j in sets if i < j and sets[i] and sets[j]
            and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(gone) == 3 and set(apart) == set(unique) - gone

    assert set(masked) == set(apart) and "hunter2secret99" not in masked[320]
    assert all(masked[i] == apart[i] for i in apart if i != 320)
    before, after = rows[320].split(SECRET)
    assert masked[320].startswith(before) and masked[320].endswith(after)

    pieces = [r.asDict() for r in corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()]
    whole = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    for out in (pieces, whole):
        assert {p["doc_id"] for p in out} == set(masked)
        filled = {}
        for p in sorted(out, key=lambda p: p["offset"]):
            assert p["offset"] == filled.get(p["sequence_id"], 0)
            filled[p["sequence_id"]] = p["offset"] + p["length"]
        assert max(filled.values()) <= 2048
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(p[k] for k in key) for p in pieces) == sorted(tuple(p[k] for k in key) for p in whole)


def test_an_empty_table_passes_every_stage(spark, planted, tmp_path):
    folder, _, _ = planted
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_cross_to_python_in_small_batches_unless_the_caller_set_smaller_ones(spark):
    def lengths(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for own, most in (("10000", corpus_pipeline.ARROW_ROWS), ("0", corpus_pipeline.ARROW_ROWS), ("70", 70)):
            spark.conf.set(name, own)
            docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
            corpus_pipeline.mask_secrets(spark, docs, "")
            sizes = [r.n for r in spark.range(0, 1200, 1, 1).mapInArrow(lengths, "n long").collect()]
            assert max(sizes) == most and sum(sizes) == 1200
    finally:
        spark.conf.set(name, before)


def test_batches_that_cross_to_python_are_bounded_in_bytes_unless_the_caller_set_fewer(spark):
    def weights(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64()), pa.array([b.nbytes], pa.int64())],
                                             names=["n", "size"])

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch",
             "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(n) for n in names]
    try:
        for own, most in (("64m", corpus_pipeline.ARROW_BYTES), ("2000000000", corpus_pipeline.ARROW_BYTES), ("1m", 1 << 20)):
            spark.conf.set(names[1], own)
            spark.conf.set(names[2], "4096")
            docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
            corpus_pipeline.drop_copies(spark, docs, "")
            long = spark.range(0, 120, 1, 1).selectExpr("repeat('x', 100000) as text")
            sizes = [(r.n, r.size) for r in long.mapInArrow(weights, "n long, size long").collect()]
            assert max(s for _, s in sizes) < most + 200_000 and sum(n for n, _ in sizes) == 120
            assert int(spark.conf.get(names[2])) == corpus_pipeline.ARROW_ROWS
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)

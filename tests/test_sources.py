"""File trees and zip archives as DataFrames, decoding rules."""

import zipfile

from pyspark.sql import functions as F

from srcatlas.operators.chunk import decode_content
from srcatlas.sources import files


def test_source_tree(spark, tmp_path):
    root = tmp_path / "trees"
    (root / "acme" / "pkg").mkdir(parents=True)
    (root / "acme" / "pkg" / "a.py").write_bytes(b"import os\r\nx = 1\r\n")
    (root / "acme" / "big.py").write_bytes(b"x" * 50_001)
    (root / "other").mkdir()
    (root / "other" / "b.ts").write_bytes(b"bad \xff byte\n")
    got = {(r.repo_name, r.rel_path): r for r in files.read_source_tree(spark, str(root)).collect()}
    assert set(got) == {("acme", "pkg/a.py"), ("acme", "big.py"), ("other", "b.ts")}
    big = got[("acme", "big.py")]                     # not read, but selection and its audit see it
    assert (big.content, big.size) == ("", 50_001)
    assert got[("acme", "pkg/a.py")].content == "import os\nx = 1\n"
    assert got[("other", "b.ts")].content == "bad � byte\n"


def test_repo_archives(spark, tmp_path):
    zdir = tmp_path / "zips"
    zdir.mkdir()
    with zipfile.ZipFile(zdir / "proj.zip", "w") as zf:
        zf.writestr("proj-main/", "")
        zf.writestr("proj-main/app.py", "print(1)\n")
        zf.writestr("proj-main/core/db.py", "x = 2\r")
    got = {(r.repo_name, r.rel_path): (r.content, r.size) for r in files.read_repo_archives(spark, str(zdir)).collect()}
    assert got == {("proj", "app.py"): ("print(1)\n", 9), ("proj", "core/db.py"): ("x = 2\n", 6)}


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b"a\r\nb\rc\xe2\x82"),)], "b binary")
    assert df.select(decode_content("b").alias("t")).first().t == "a\nb\nc�"


def test_archives_come_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE_BYTES", 10)
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as zf:
        for i in range(20):
            zf.writestr(f"many-main/f{i}.py", f"x = {i}\n")
    got = files.read_repo_archives(spark, str(tmp_path)).collect()
    assert {r.rel_path: r.content for r in got} == {f"f{i}.py": f"x = {i}\n" for i in range(20)}


def test_source_tree_root_with_pattern_characters(spark, tmp_path):
    root = tmp_path / "a+b(c)"
    (root / "acme").mkdir(parents=True)
    (root / "acme" / "m.py").write_text("x = 1\n")
    assert [(r.repo_name, r.rel_path) for r in files.read_source_tree(spark, str(root) + "/").collect()] == [("acme", "m.py")]

"""Repository sources (S1-S3): file trees and zip archives read as DataFrames.

Both produce ``repo_name, rel_path, content (string), size (bytes)``.  File listing
and reading are Spark's ``binaryFile`` source (size filters push down, content is
read only when used); archives are unpacked one archive per row in
``mapInPandas``.  Fetching archives over HTTP is not part of this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import MAX_FILE_BYTES
from ..operators.chunk import decode_content

#: Bytes of unpacked files that a task holds before it passes them on.
PIECE_BYTES = 16 << 20


def read_source_tree(spark: SparkSession, path: str, repo_depth: int = 1,
                     max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """Every file under ``path``; the first ``repo_depth`` directory levels name the repo.

    Files of more than ``max_bytes`` come with their true size and empty content, as those of an
    archive do: the content is not read, and selection (P6) and its audit (P13) see the row.
    """
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(root).toString()
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_bytes is not None:
        # a scan that does not select the content does not open the files
        large = df.filter(F.col("length") > max_bytes).drop("content").withColumn("content", F.lit(b""))
        df = df.filter(F.col("length") <= max_bytes).unionByName(large)
    parts = F.split(F.substr("path", F.lit(len(root.rstrip("/")) + 2)), "/")
    return df.select(
        F.array_join(F.slice(parts, 1, repo_depth), "/").alias("repo_name"),
        F.array_join(F.slice(parts, repo_depth + 1, F.size(parts)), "/").alias("rel_path"),
        decode_content("content").alias("content"), F.col("length").alias("size"))


def read_repo_archives(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """One zip per repository (name = archive name without ``.zip``); every entry
    loses its top-level folder, as a ``<repo>-main/`` download has."""
    zips = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
            .select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("repo_name"), "content"))

    def unzip(batches):
        import io
        import zipfile
        import pandas as pd
        def frame(rows):
            return pd.DataFrame(rows, columns=["repo_name", "rel_path", "raw", "size"])

        for pdf in batches:
            rows, held = [], 0
            for repo, blob in zip(pdf["repo_name"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(blob)) as zf:
                    for info in zf.infolist():
                        if info.is_dir():
                            continue
                        parts = info.filename.split("/", 1)
                        if len(parts) < 2 or not parts[1]:
                            continue
                        data = zf.read(info) if info.file_size <= MAX_FILE_BYTES else b""
                        rows.append((repo, parts[1], data, info.file_size))
                        held += len(data)
                        if held > PIECE_BYTES:
                            yield frame(rows)
                            rows, held = [], 0
            yield frame(rows)

    from ..session import ship_package
    ship_package(spark)
    files = zips.mapInPandas(unzip, "repo_name string, rel_path string, raw binary, size bigint")
    return files.select("repo_name", "rel_path", decode_content("raw").alias("content"), "size")

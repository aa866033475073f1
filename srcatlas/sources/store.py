"""Persistence and lookups (S4, S5, S8, S9, J9) on Parquet tables partitioned by repository.

Replacing one repository's index is a dynamic partition overwrite: only the
partitions present in the written data are replaced, so other repositories are
untouched and the write is one job, not a delete + insert.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import metadata_id

#: Folder inside a table with its columns and no rows; partition overwrites and scans of the table leave it alone.
COLUMNS = "_columns"


def index_admission(chunks: DataFrame, repos: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """``repo_name, n_chunks, status, message``; 0 chunks or, where a limit is asked for (1000 in
    the reference), more than ``max_chunks`` is an error and nothing of that repository is written
    (its old index is kept).  The messages are fixed values."""
    n = chunks.groupBy("repo_name").agg(F.count(F.lit(1)).alias("n_chunks"))
    r = repos.select("repo_name").distinct().join(n, "repo_name", "left").fillna(0, ["n_chunks"])
    too_big = F.lit(False) if max_chunks is None else F.col("n_chunks") > max_chunks
    return r.select("repo_name", F.col("n_chunks").cast("bigint").alias("n_chunks"),
                    F.when((F.col("n_chunks") == 0) | too_big, "error").otherwise("success").alias("status"),
                    F.when(F.col("n_chunks") == 0, F.lit("No chunks provided — nothing to embed."))
                    .when(too_big, F.format_string("Repository too large. %d chunks exceeds limit.", "n_chunks"))
                    .otherwise(F.lit("")).alias("message"))


def write_chunk_index(chunks: DataFrame, path: str) -> None:
    """Replace all chunks of the repositories present in ``chunks``; nothing else."""
    spark = chunks.sparkSession
    # Range partitioning on (repo, ids): a repository holding a third of the rows is
    # written by many tasks, and each task writes few repository partitions.
    order = [c for c in ("chunk_id", "block", "node", "src", "dst") if c in chunks.columns]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (chunks.repartitionByRange(n, "repo_name", *order)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_name").parquet(path))
    chunks.limit(0).write.mode("overwrite").parquet(f"{path}/{COLUMNS}")


def read_chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; one whose writes had no rows (every repository was refused) is empty, with its columns."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        empty = spark.read.parquet(f"{path}/{COLUMNS}")
        return empty.select(*(c for c in empty.columns if c != "repo_name"), "repo_name")


def upsert_metadata(spark: SparkSession, path: str, updates: DataFrame, order: str | None = None) -> None:
    """key = md5(repo_name); last write wins.  Written per repository partition.

    ``order`` names the column that says which of several updates of one batch came last; without
    it a batch is expected to hold one row per repository.
    """
    rows = (updates.withColumn("metadata_id", metadata_id("repo_name"))
            .withColumn("updated_at", F.current_timestamp()))
    w = Window.partitionBy("metadata_id").orderBy(F.col(order or "updated_at").desc_nulls_last())
    latest = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    write_chunk_index(latest, path)


def lookup_metadata(metadata: DataFrame, repos: DataFrame) -> DataFrame:
    """At most one record per requested repository; none → NULL columns."""
    return repos.select("repo_name").distinct().join(metadata, "repo_name", "left")


def read_through(repos: DataFrame, metadata: DataFrame) -> DataFrame:
    """Stored artefacts or ``missing`` status per requested repository."""
    m = metadata.withColumn("_found", F.lit(True))
    return (repos.select("repo_name").distinct().join(m, "repo_name", "left")
            .withColumn("status", F.when(F.col("_found").isNull(), "missing").otherwise("success"))
            .drop("_found"))

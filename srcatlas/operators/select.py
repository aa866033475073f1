"""File selection (P1-P7, P12, P13): which source files are worth analysing.

Input: ``repo_name, rel_path, size[, content]``.  Everything is a narrow filter except
the optional per-repo cap, which is a ``row_number() <= n`` window that Spark plans
as ``WindowGroupLimit`` (a partial top-n runs before the shuffle, so even a huge
repository ships at most ``n`` rows per input partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

DEFAULT_MAX_FILES = 500

# Reasons in the order the reference checks them (first match wins).
REASONS = ("skipped_dir", "skipped_name", "test_file", "skipped_suffix", "unsupported_language",
           "empty", "too_large")


def skip_reason(path="rel_path", size="size"):
    """First reason a file is dropped, or NULL when it is selected."""
    s = F.col(size) if isinstance(size, str) else size
    return (F.when(P.in_skipped_dir(path), "skipped_dir")
            .when(P.is_skipped_name(path), "skipped_name")
            .when(P.is_test_file(path), "test_file")
            .when(P.has_skipped_suffix(path), "skipped_suffix")
            .when(P.language_of(path).isNull(), "unsupported_language")
            .when(s <= 0, "empty")
            .when(s > P.MAX_FILE_BYTES, "too_large"))


def is_selected(path="rel_path", size="size"):
    return (~P.in_skipped_dir(path) & ~P.is_skipped_name(path) & ~P.is_test_file(path)
            & ~P.has_skipped_suffix(path) & P.language_of(path).isNotNull() & P.size_ok(size))


def select_sources(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Keep analysable files and add ``language``.

    ``max_files`` is the reference's per-repo cap (500 there); ``None`` keeps all.
    The cap keeps the first files in code-point ``rel_path`` order, a deterministic
    stand-in for directory-walk order.
    """
    out = (files.withColumn("rel_path", P.normalize_path("rel_path"))
           .filter(is_selected())
           .withColumn("language", P.language_of("rel_path")))
    if max_files is not None:
        w = Window.partitionBy("repo_name").orderBy("rel_path")
        out = out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_files).drop("_rn")
    return out


def selection_audit(files: DataFrame) -> DataFrame:
    """Number of files per repo and first skip reason (``selected`` when kept)."""
    return (files.select("repo_name",
                         F.coalesce(skip_reason(P.normalize_path("rel_path")), F.lit("selected")).alias("reason"))
            .groupBy("repo_name", "reason").agg(F.count(F.lit(1)).alias("n_files")))


def repos_without_sources(repos: DataFrame, selected: DataFrame) -> DataFrame:
    """Requested repositories whose selection is empty become error rows."""
    return (repos.select("repo_name").distinct()
            .join(selected.select("repo_name"), "repo_name", "left_anti")
            .select("repo_name", F.lit("error").alias("status"),
                    F.lit("No supported source files found. Supported: .py, .js, .ts, .jsx, .tsx")
                    .alias("message")))

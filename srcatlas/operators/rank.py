"""Architecture relevance.

``file_score`` is a pure column expression; the per-file best chunk is a
``max_by`` aggregation (partial aggregation before the shuffle keeps one row per
file per task), and the per-repository top 12 is a ``WindowGroupLimit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

# Fixed values that must equal the reference's for identical scores.
PRIORITY_NAMES = ("main.py", "app.py", "server.py", "index.ts", "index.js", "main.tsx", "app.tsx", "config.py")
NEGATIVE_NAMES = ("eslint.config.js", "postcss.config.js", "tailwind.config.js")
KEYWORDS = ("api", "route", "router", "service", "agent", "controller", "core", "storage", "database", "db",
            "graph", "llm", "retrieval", "frontend", "backend")
PRIORITY_POINTS, KEYWORD_POINTS, CONFIG_POINTS, NEGATIVE_POINTS = 100, 20, 15, -100


def file_score(path) -> Column:
    """+100 priority name, +20 per keyword substring of the path, +15 'config' in the
    name, -100 negative name (names and path lower-cased)."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    name = F.lower(P.file_name(F.col(path) if isinstance(path, str) else path))
    kw = sum(F.when(p.contains(k), KEYWORD_POINTS).otherwise(0) for k in KEYWORDS)
    return (F.when(name.isin(*PRIORITY_NAMES), PRIORITY_POINTS).otherwise(0) + kw
            + F.when(name.contains("config"), CONFIG_POINTS).otherwise(0)
            + F.when(name.isin(*NEGATIVE_NAMES), NEGATIVE_POINTS).otherwise(0))


def best_chunk_per_file(chunks: DataFrame) -> DataFrame:
    """The longest chunk of each file; the first (smallest id) on ties."""
    best = F.max_by(F.struct(*[F.col(c) for c in chunks.columns]),
                    F.struct(F.length("text"), -F.col("chunk_id")))
    rest = [c for c in chunks.columns if c not in ("repo_name", "file_path")]
    return (chunks.groupBy("repo_name", "file_path").agg(best.alias("b"))
            .select("repo_name", "file_path", *[F.col("b")[c].alias(c) for c in rest]))


def select_architecture_chunks(chunks: DataFrame, max_chunks: int = 12) -> DataFrame:
    """K5: best chunk per file, top ``max_chunks`` files by score; stable, so ties keep the
    order in which files first appear (their first chunk id)."""
    firsts = chunks.groupBy("repo_name", "file_path").agg(F.min("chunk_id").alias("_first"))
    best = best_chunk_per_file(chunks).join(firsts, ["repo_name", "file_path"])
    w = Window.partitionBy("repo_name").orderBy(F.col("score").desc(), "_first")
    return (best.withColumn("score", file_score("file_path"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_chunks).drop("_first"))


def file_listing(chunks: DataFrame) -> DataFrame:
    """Distinct file paths, sorted, joined by newline (per repository)."""
    return chunks.groupBy("repo_name").agg(
        F.array_join(F.array_sort(F.collect_set("file_path")), "\n").alias("repo_structure"))

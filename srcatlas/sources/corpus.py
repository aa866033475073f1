"""Driver tables and the derived code corpus.

The driver tables carry prose, not code.  ``CODE_CORPUS_SQL`` turns ``documents``
into a multi-repository source corpus (paths, imports, definitions prepended to the
prose) with one SQL text that runs unchanged in Spark and in DuckDB, so every job
downstream can be checked against an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snippets import planted_sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed derivation of the code corpus (shared with the DuckDB oracle). Reads the view
# or DataFrame argument named ``documents``.
#: Facts of a file that follow from its document's number; ``base_lines`` counts the lines before the snippet.
FILES_SQL = """
SELECT *,
  CASE WHEN doc_id % 5 = 4 AND doc_id % 3 <> 1 THEN concat(dir, 'm', k, '.txt')
       WHEN doc_id % 97 = 0 THEN concat(dir, 'v', k, '/videos.', ext)
       WHEN doc_id % 23 = 0 THEN concat('node_modules/m', k, '.', ext)
       WHEN doc_id % 29 = 0 THEN concat('.cache/m', k, '.', ext)
       WHEN doc_id % 31 = 0 THEN concat(dir, 'test_m', k, '.', ext)
       WHEN doc_id % 37 = 0 THEN concat(dir, 'm', k, '.min.js')
       WHEN doc_id % 41 = 0 THEN concat(dir, 'm', k, '.md')
       WHEN doc_id % 43 = 0 AND ext = 'py' THEN concat(dir, 'm', k, '/__init__.py')
       WHEN doc_id % 43 = 0 THEN concat(dir, 'm', k, '/index.', ext)
       WHEN doc_id % 47 = 0 THEN concat('frontend/src/m', k, '.', ext)
       ELSE concat(dir, 'm', k, '.', ext) END AS rel_path,
  CASE ext WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' ELSE 'typescript' END AS language,
  CASE WHEN ext <> 'py' OR doc_id < 20 THEN 1 ELSE 2 END + CASE WHEN ext = 'py' AND doc_id % 7 = 0 THEN 1 ELSE 0 END
    + CASE WHEN doc_id % 100 IN (0, 1, 40, 41) THEN 1 ELSE 0 END AS base_lines
FROM (SELECT doc_id, text,
    concat('repo', CAST(doc_id % 5 AS VARCHAR(20))) AS repo_name,
    CASE WHEN doc_id % 3 = 0 THEN 'api/routes/' WHEN doc_id % 3 = 1 THEN 'core/' ELSE '' END AS dir,
    CASE WHEN doc_id % 3 = 0 THEN '../../' WHEN doc_id % 3 = 1 THEN '../' ELSE './' END AS up,
    CASE WHEN (doc_id + 1) % 3 = 0 THEN 'api/routes/' WHEN (doc_id + 1) % 3 = 1 THEN 'core/' ELSE '' END AS dir_of_prev20,
    CASE doc_id % 16 WHEN 3 THEN 'ts' WHEN 7 THEN 'tsx' WHEN 11 THEN 'js' WHEN 15 THEN 'jsx' ELSE 'py' END AS ext,
    CAST(doc_id AS VARCHAR(20)) AS k,
    CAST(doc_id - 20 AS VARCHAR(20)) AS k_m20,
    CAST(doc_id - 10 AS VARCHAR(20)) AS k_m10,
    CAST(doc_id + 20 AS VARCHAR(20)) AS k_p20,
    CAST(doc_id + 40 AS VARCHAR(20)) AS k_p40,
    CAST(doc_id - doc_id % 235 + 47 * ((3 * doc_id) % 5) AS VARCHAR(20)) AS k47,
    chr(10) AS nl
  FROM {documents}) d"""

# Fixed derivation of the code corpus (shared with the DuckDB oracle). Reads the view
# or DataFrame argument named ``documents``.
CODE_CORPUS_SQL = f"""
SELECT repo_name, doc_id, rel_path,
  concat(
    CASE WHEN ext <> 'py' AND doc_id >= 20 THEN concat('import {{ x }} from ''', up, dir_of_prev20, 'm', k_m20, ''';', nl)
         WHEN ext <> 'py' THEN concat('import React from ''react'';', nl)
         WHEN doc_id >= 20 THEN concat('import m', k_m20, ' as prev', nl, 'from .m', k_m10, ' import thing', nl)
         ELSE concat('from __future__ import annotations', nl) END,
    CASE WHEN ext = 'py' AND doc_id % 7 = 0 THEN concat('import os, sys', nl) ELSE '' END,
    CASE WHEN doc_id % 100 IN (0, 1) THEN concat('from m', k_p20, ' import later', nl)
         WHEN doc_id % 100 IN (40, 41) THEN concat('from m', k_p40, ' import later', nl) ELSE '' END,
    {planted_sql()},
    text) AS content
FROM ({FILES_SQL}) b
"""


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo_name, rel_path, content, size`` derived from ``documents`` (narrow: no shuffle)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = CODE_CORPUS_SQL.replace("{", "{{").replace("}", "}}").replace("{{documents}}", "{documents}")
    df = spark.sql(text, documents=docs)
    return df.select("repo_name", "rel_path", "content",
                     F.octet_length("content").cast("bigint").alias("size"))


def corpus_cte() -> str:
    """The corpus as a DuckDB CTE body named ``code_corpus`` (adds ``size``)."""
    inner = CODE_CORPUS_SQL.replace("{documents}", "documents")
    return (f"code_corpus AS (SELECT repo_name, rel_path, content, "
            f"CAST(octet_length(encode(content)) AS BIGINT) AS size FROM ({inner}) cc)")

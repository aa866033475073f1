"""A training corpus from ``documents``: clean, deduplicate, mask secrets, pack into sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from srcatlas.llm import best_fit_packing, exact_dedup, ngram_join, secret_scan, toxicity
from srcatlas.llm.common import table
from srcatlas.llm.registry import tokenizer
from srcatlas.session import materialize


#: Rows of a batch that crosses between Spark and Python; such a batch of whole texts lies several times in an executor.
ARROW_ROWS = 500
#: Bytes of such a batch, which ends with the row that reaches them: rows may be long texts or pieces of them.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of at most ``ARROW_ROWS`` rows and about ``ARROW_BYTES``, read from Parquet ``ARROW_ROWS`` at a time, in
    this session from here on: at the defaults the buffers of whole texts, which the allocators keep, add up over the
    stages that share the executors."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES),
                       ("spark.sql.parquet.columnarReaderBatchSize", ARROW_ROWS)):
        own = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(name).strip().lower())
        if not own or not 0 < int(own[1]) << 10 * " kmgt".index(own[2] or " ") <= most:
            spark.conf.set(name, most)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    small_batches(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (five words, similarity 0.8)."""
    small_batches(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    small_batches(spark)
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenised and packed into sequences of at most 2048 tokens."""
    small_batches(spark)
    return best_fit_packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
          ("secret scans", mask_secrets), ("best-fit packing", pack)]

#: Trained, iterative and tokenising stages have no SQL; tests/llm/test_pipeline.py compares every stage and run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i + 1}")
    return docs

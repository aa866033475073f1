"""Chunking (C1-C10): cut each selected file into definition chunks or 50-line chunks.

Every file row is turned into an array of chunks inside the row (files are at most 50,000 bytes after
selection): definitions on Arrow batches (``definitions``), lines by higher-order functions, so the cutting is
narrow.  The chunk ids (dense per repository, in the reference's emission order) need the sums of the chunk
counts of the files before (``ordinals.running_totals``); no text moves for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .ordinals import running_totals, spread, travelling
from ..session import materialize
from . import definitions

MIN_CHARS = 50
MAX_CHARS = 3000
LINES_PER_CHUNK = 50
# Python ``str.splitlines`` boundaries; a trailing boundary makes no extra line.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def decode_content(content) -> Column:
    """S3: bytes -> text; invalid UTF-8 becomes U+FFFD, ``\\r\\n`` and ``\\r`` become ``\\n``."""
    c = F.col(content) if isinstance(content, str) else content
    text = F.make_valid_utf8(c.cast("string"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def split_lines(text) -> Column:
    """Python ``splitlines()`` as a Spark array."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.split(t, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_chunk_array(lines: Column, lines_per_chunk: int = LINES_PER_CHUNK,
                     min_chars: int = MIN_CHARS) -> Column:
    """Consecutive groups of ``lines_per_chunk`` lines, kind ``raw``, short groups dropped."""
    n = F.size(lines)
    L = lines_per_chunk
    groups = F.filter(F.sequence(F.lit(0), F.greatest(F.ceil(n / L).cast("int") - 1, F.lit(0))),
                      lambda g: g * L < n)

    def one(g):
        start = g * L + 1
        end = F.least(g * L + L, n)
        return F.struct(F.array_join(F.slice(lines, start, L), "\n").alias("text"),
                        F.lit("raw").alias("chunk_type"),
                        F.concat(F.lit("lines_"), start.cast("string"), F.lit("_"), end.cast("string")).alias("name"),
                        start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))

    return F.filter(F.transform(groups, one), lambda c: F.length(c["text"]) >= min_chars)


def line_chunks(files: DataFrame, lines_per_chunk: int = LINES_PER_CHUNK,
                min_chars: int = MIN_CHARS) -> DataFrame:
    """C6 on every file: ``repo_name, file_path, language`` + chunk fields (no ids)."""
    arr = let(split_lines("content"), lambda lines: line_chunk_array(lines, lines_per_chunk, min_chars))
    return (spread(files).filter(~P.is_blank("content"))
            .select("repo_name", F.col("rel_path").alias("file_path"), "language",
                    F.explode(arr).alias("c"))
            .select("repo_name", "file_path", "language", "c.*"))


def let(value: Column, body) -> Column:
    """Bind ``value`` once to a lambda variable and evaluate ``body`` on it.

    Catalyst may inline a projected column into every place it is used; a one-element
    ``transform`` evaluates the shared value exactly once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def chunk_files(files: DataFrame, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS,
                lines_per_chunk: int = LINES_PER_CHUNK, definitions_enabled: bool = True, splitter=None,
                split_long: bool = False, abstract_classes: bool = False) -> DataFrame:
    """Flat chunk table with dense ``chunk_id`` per repository.

    A file's definition chunks if at least one survives ``min_chars``, else its 50-line chunks (C7).  Ids follow
    file order (code-point ``rel_path``) then in-file emission order, like the reference's
    ``range(len(chunks))`` over its flat list.
    """
    spread_files = spread(files)
    lines = lambda text: let(split_lines(text), lambda ls: line_chunk_array(ls, lines_per_chunk, min_chars))
    if definitions_enabled:
        found = definitions.with_definitions(spread_files, min_chars, max_chars, splitter, split_long, abstract_classes)
        arr = F.when(F.size("defs") > 0, F.col("defs")).otherwise(lines("rest"))
    else:
        found = spread_files.filter(~P.is_blank("content")).withColumnRenamed("rel_path", "file_path")
        arr = lines("content")
    rows = found.select("repo_name", "file_path", "language", F.posexplode(arr).alias("pos", "c"))
    # The texts are written once and stay there: ids need the number of chunks per file alone, so what is
    # sorted and summed is a thin table of files.
    rows = materialize(rows, "chunk-rows")
    sizes = rows.groupBy("repo_name", "file_path").agg(F.count(F.lit(1)).alias("_n"))
    first = running_totals(sizes, ["repo_name"], ["file_path"], "_n", "_first")
    keys = ["repo_name", "file_path"]
    numbered = rows.join(travelling(first.select(*keys, "_first"), keys), keys)
    return numbered.select("repo_name", (F.col("_first") + F.col("pos")).cast("bigint").alias("chunk_id"), "file_path",
                           "c.chunk_type", "c.name", "c.start_line", "c.end_line", "language", "c.text")

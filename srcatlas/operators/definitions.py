"""Definition chunks (C1-C5): functions, classes and types of each file, cut at their spans.

The spans come from ``functions.lexing``, a file at a time inside ``mapInArrow``; a ``splitter`` replaces it by
any other parser.  Places are code points, lines are counted by ``\\n`` alone, and chunks of a file are in the
reference's emission order: later spans first, an enclosing span before its members.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexing
from ..session import released, ship_package, sliced

TRUNCATION_MARK = "\n... [truncated]"
CHUNK = "text string, chunk_type string, name string, start_line int, end_line int"


def pieces(text: str, start: int, end: int, most: int):
    """Consecutive pieces of ``text[start:end]`` of at most ``most`` characters, cut behind line breaks where possible."""
    while end - start > most:
        cut = text.rfind("\n", start, start + most) + 1
        cut = cut if cut > start else start + most
        yield start, cut
        start = cut
    yield start, end


def cut(text: str, spans, min_chars: int, max_chars: int, split_long: bool) -> list[tuple]:
    """Chunks (text, chunk_type, name, start_line, end_line) of the spans in emission order.

    Shorter spans than ``min_chars`` are left out.  Longer ones than ``max_chars`` are cut there and marked, or,
    with ``split_long``, give a chunk per piece, none of which is left out.
    """
    if not spans:
        return []
    breaks = [m.start() for m in re.finditer("\n", text)]

    def row(start, end, kind, name, mark=""):
        body = text[start:end]
        return (body + mark, kind, name, bisect_right(breaks, start - 1) + 1, bisect_right(breaks, start + len(body.rstrip("\n")) - 1) + 1)

    out = []
    for start, end, kind, name in sorted(spans, key=lambda s: (-s[1], s[0])):
        if end - start < min_chars:
            continue
        if end - start <= max_chars:
            out.append(row(start, end, kind, name))
        elif split_long:
            out += [row(a, b, kind, name) for a, b in pieces(text, start, end, max_chars)]
        else:
            whole = row(start, end, kind, name)
            out.append((whole[0][:max_chars] + TRUNCATION_MARK, *whole[1:]))
    return out


def with_definitions(files: DataFrame, min_chars: int, max_chars: int, splitter=None, split_long: bool = False,
                     abstract_classes: bool = False) -> DataFrame:
    """``repo_name, file_path, language, defs`` (array of chunks) and ``rest``: the content where ``defs`` is empty.

    ``splitter(text, language)`` returns (start, end, kind, name) spans in code points; None stands for the
    built-in spans.  Files that are blank give no row.
    """
    ship_package(files.sparkSession)

    @released
    def run(batches):
        import pyarrow as pa

        find = splitter or (lambda text, language: lexing.spans_of(text, language, abstract_classes))
        kind = pa.list_(pa.struct([("text", pa.string()), ("chunk_type", pa.string()), ("name", pa.string()),
                                   ("start_line", pa.int32()), ("end_line", pa.int32())]))
        names = [f.name for f in kind.value_type]
        for batch in sliced(batches):
            defs, rest = [], []
            for text, language in zip(batch.column("content").to_pylist(), batch.column("language").to_pylist()):
                text = text or ""
                found = cut(text, find(text, language), min_chars, max_chars, split_long) if text.strip() else []
                defs.append([dict(zip(names, c)) for c in found])
                rest.append(None if found or not text.strip() else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("repo_name"), batch.column("file_path"), batch.column("language"), pa.array(defs, kind),
                 pa.array(rest, pa.string())], names=["repo_name", "file_path", "language", "defs", "rest"])

    rows = files.select("repo_name", F.col("rel_path").alias("file_path"), "language", "content")
    return rows.mapInArrow(run, f"repo_name string, file_path string, language string, defs array<struct<{_typed()}>>, rest string")


def _typed() -> str:
    return ", ".join(":".join(c.split()) for c in CHUNK.split(", "))


def definition_chunks(files: DataFrame, min_chars: int = 50, max_chars: int = 3000, splitter=None,
                      split_long: bool = False, abstract_classes: bool = False) -> DataFrame:
    """C1-C5 only (no fallback, no ids): one row per surviving definition."""
    from .ordinals import spread
    found = with_definitions(spread(files), min_chars, max_chars, splitter, split_long, abstract_classes)
    return found.select("repo_name", "file_path", "language", F.explode("defs").alias("c")).select(
        "repo_name", "file_path", "language", "c.*")

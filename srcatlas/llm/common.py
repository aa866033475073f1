"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import released  # noqa: F401  (used by the operators)

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one.
LONG_WORD = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def utf8_rows(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the n + 1 row offsets into them (nulls are empty)."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def ascii_lower_bytes(raw: np.ndarray) -> np.ndarray:
    """A copy of UTF-8 bytes with A-Z lower-cased (bytes of longer characters are all above 127)."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


def word_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``raw[first:last]``, byte column by byte column over all words at once."""
    import xxhash

    size = last - first
    order = np.argsort(-size, kind="stable")
    size, start = size[order], first[order]
    out = np.zeros(len(order), np.uint64)
    long = int(np.searchsorted(-size, -LONG_WORD, "left"))
    for i in range(long):
        out[i] = xxhash.xxh64_intdigest(raw[start[i]:start[i] + size[i]].tobytes())
    power, k = np.uint64(1), 0
    with np.errstate(over="ignore"):
        while True:
            active = int(np.searchsorted(-size, -k, "left"))
            if active <= long:
                break
            out[long:active] += _BYTES[raw[start[long:active] + k]] * power
            power, k = power * MULTIPLIER, k + 1
        result = np.empty_like(out)
        result[order] = mix(out + size.astype(np.uint64) * MULTIPLIER)
    return result


#: Ids that a semi-join or anti-join may broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def without(rows: DataFrame, dropped: DataFrame, same: Column, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` that match no row of ``dropped``, a thin table of ids.

    Up to ``limit`` ids, counted first, travel to the rows, so that texts stay where they are; beyond, both
    sides are shuffled.  The result is the same.
    """
    few = dropped.count() <= limit
    return rows.join(F.broadcast(dropped) if few else dropped, same, "left_anti")


def only(rows: DataFrame, ids: DataFrame, same: Column, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The ``rows`` that match a row of ``ids``, a thin table, if these are at most ``limit``; else all ``rows``.

    What is joined with ``ids`` afterwards anyhow then shuffles no more texts than it has to.
    """
    return rows.join(F.broadcast(ids), same, "left_semi") if ids.count() <= limit else rows

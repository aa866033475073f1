"""Mixing sources to target weights (operator 11).

Tokens are summed per source; from the sums follow the sources' targets and from these their repetition
rates.  A document is emitted floor(rate) times, plus once more if a draw seeded by the hash of its id and
text falls below the rate's fraction, so that each source's expected share is exactly its target and a rerun
draws the same copies.

Sources in code-point order (null last) take ``weights`` in turn and share ``share`` times all tokens by
weight.  No target passes ``most`` times its source's tokens: with a common level, a source gets the smaller
of weight * level and that cap.  The level is found by rounds of one aggregation over the table of sources;
each round settles every source that the last level lifted above its cap, and the level only rises.

Everything is a DataFrame expression.  Sizes are pre-aggregated per source before the shuffle, so a source
with a third of all rows costs what any other does.  Documents meet their source's rate by a broadcast if
the sources, counted and measured first, are few, and otherwise by a join salted against hot sources; no
text takes part in the ranking.

Defined results: a null text has no tokens; null and empty sources are two sources; documents without tokens
are taken as a copy like others, with 0 tokens; if no document has tokens, all targets are 0 and nothing is
emitted; a repeated row is a document each time and shares its draw with its equals; an empty table gives an
empty result; extra columns travel with their document, and one named like the copy number gives way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import group_ordinals
from ..session import materialize

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Sources, and bytes of their names, that may be broadcast.
FEW_SOURCES, FEW_BYTES = 100_000, 8 << 20
#: A hot source's rows are dealt over so many keys where sources are too many to broadcast.
SALTS = 32


def n_words(text):
    """The number of ``[^\\x20\\x09-\\x0D]+`` in ``text``: every word becomes one letter, which is counted."""
    ones = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(ones, " \t\n\x0b\x0c\r", "")).cast("long")


def draw(id_col, text, seed: str):
    """A number in [0, 1) with 52 random bits, from a hash of seed, id and text."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")),
                      F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0 ** 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """source, source_size, weight, target, rate from a row (source, source_size) per source."""
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(
        group_ordinals(sizes.withColumn("nameless", F.col("source").isNull()), [], ["nameless", "source"], "rank")
        .select("source", "source_size", turn.cast("long").alias("weight")), "mix-sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, settled = 0.0, -1
    while total:
        above = F.col("weight") * F.lit(level) > cap
        n, held, rest = ranked.agg(F.count_if(above), F.sum(F.when(above, F.col("source_size")).otherwise(0)),
                                   F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if n == settled or not rest:
            break
        settled, level = n, (share * total - most * held) / rest
    target = F.least(F.col("weight") * F.lit(level), cap)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return ranked.withColumn("target", target).withColumn("rate", rate)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
           most: float = MOST) -> DataFrame:
    """row (all columns of ``docs``), size, source_size, target, rate and copies of every document."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"),
                       F.col(source_col).alias("s"), n_words(F.col(text_col)).alias("size"))
    sizes = rows.groupBy(F.col("s").alias("source")).agg(F.sum("size").alias("source_size"))
    rates = targets(sizes, weights, share, most)
    n, width = rates.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    same = F.col("s").eqNullSafe(F.col("source"))
    if n <= FEW_SOURCES and width <= FEW_BYTES:
        met = rows.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = (rows.withColumn("k", F.pmod(F.xxhash64("id", "size"), F.lit(SALTS)).cast("int"))
               .join(salted, same & (F.col("k") == F.col("salt"))))
    whole = F.floor("rate")
    extra = (draw(F.col("id"), F.col("t"), seed) < F.col("rate") - whole).cast("long")
    return met.select("row", "size", "source_size", "target", "rate", (whole + extra).alias("copies"))


def mix(docs: DataFrame, copy_col: str = "copy", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns and the copy's number from 1."""
    taken = assign(docs, **options).where("copies > 0")
    numbered = taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("n"))
    kept = [c for c in docs.columns if c.lower() != copy_col.lower()]
    return numbered.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("n").alias(copy_col))

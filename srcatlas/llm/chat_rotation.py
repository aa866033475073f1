"""Multi-party perspective rotation of dialogues (operator 8).

For every participant of a conversation the whole dialogue is rendered once with that speaker as the
assistant and all others as named users; a loss mask covers what the assistant says and its end marker.
Turns of the ``CONTEXT`` roles are instructions: they are rendered in every perspective, speak for nobody
and get no perspective of their own.

The result has a row per conversation, perspective and turn, with the turn's segment and its place in the
rendered dialogue, so that no conversation is ever gathered in one row or task: rows are range-sorted by
(conversation, perspective, turn), a running sum gives the places inside a partition, and one small row per
conversation part carries the sums across partitions.

Defined results: null and empty roles are one speaker named ``unknown``; a null text is empty; a null
conversation id is a conversation of its own; null turns come first, equal turns are ordered by role, then
text; repeated rows are rendered each time; conversations of context turns alone, like empty tables, give
no rows; the markers' first two characters are broken up inside names and texts, and
line ends in names become spaces, so no text forges a marker or a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CONTEXT = ("system",)
START, END = "<|im_start|>", "<|im_end|>\n"
UNKNOWN = "unknown"
LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _safe(c):
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _name(c):
    """A name on one line: a line end in it would put the rest into the turn's text."""
    return F.regexp_replace(_safe(c), LINE_END, " ")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """conv_id, perspective, turn, speaker, position (from 1), segment, seg_start, seg_end, mask_start, mask_end.

    Places are code points in the rendered dialogue, ends exclusive; the mask is empty (start = end) for
    turns that are not the assistant's.
    """
    role = F.coalesce(F.when(F.col(role_col) != "", F.col(role_col)), F.lit(UNKNOWN))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("speaker"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    people = (rows.where(~F.col("speaker").isin(*context)).groupBy(F.col("conv_id").alias("c"), "speaker").count()
              .select("c", F.col("speaker").alias("perspective")))
    is_self = F.col("speaker") == F.col("perspective")
    head = (F.when(F.col("speaker").isin(*context), F.concat(F.lit(START), F.col("speaker"), F.lit("\n")))
            .when(is_self, F.lit(START + "assistant\n"))
            .otherwise(F.concat(F.lit(START + "user name="), _name(F.col("speaker")), F.lit("\n"))))
    views = (rows.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
             .withColumn("head", head).withColumn("segment", F.concat("head", _safe(F.col("text")), F.lit(END)))
             .withColumn("size", F.length("segment").cast("long")))
    order = ["turn", "speaker", "text"]
    dealt = materialize(views.repartitionByRange("conv_id", "perspective", *order)
                        .withColumn("pid", F.spark_partition_id()), "chat-views")
    part = Window.partitionBy("pid", "conv_id", "perspective").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("n", F.count("*").over(part)).withColumn("upto", F.sum("size").over(part))
    # what the same dialogue has in earlier partitions; only dialogues cut by a partition's edge have such rows
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = (dealt.groupBy("pid", "conv_id", "perspective").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
              .select(F.col("pid").alias("p"), F.col("conv_id").alias("c"), F.col("perspective").alias("v"),
                      F.sum("m").over(earlier).alias("n0"), F.sum("s").over(earlier).alias("s0"))
              .where("n0 is not null"))
    end = F.col("upto") + F.coalesce("s0", F.lit(0))
    start = end - F.col("size")
    same = ((F.col("pid") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c"))
            & (F.col("perspective") == F.col("v")))
    return (local.join(before, same, "left")
            .select("conv_id", "perspective", "turn", "speaker",
                    (F.col("n") + F.coalesce("n0", F.lit(0))).alias("position"), "segment",
                    start.alias("seg_start"), end.alias("seg_end"),
                    F.when(is_self, start + F.length("head")).otherwise(end).alias("mask_start"),
                    F.when(is_self, end - 1).otherwise(end).alias("mask_end")))

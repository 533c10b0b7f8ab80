"""Chat formatting: every participant's view of a dialogue.

For each speaker but the system the whole dialogue is written once more with that speaker as the
assistant, all others as named users and the system's turns as they are. Masks mark the characters that a model
should learn from: the assistant's words and the mark that ends them. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import materialise
from pairloom.operators.ordered import chunk_totals, with_carried

SYSTEM = "system"
# Turns that one row of the result holds at most; a longer dialogue goes on in the next part.
PART_TURNS = 64


def opening(speaker: Column, viewer: Column) -> Column:
    """The line that opens a turn: role, and for users the name."""
    return (
        F.when(speaker == SYSTEM, F.lit("<|system|>\n"))
        .when(speaker == viewer, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user|>"), speaker, F.lit("\n")))
    )


CLOSING = "<|end|>\n"


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per dialogue, viewer and part: ``conv_id, perspective, part, first_turn, n_turns, rendered, mask, n_chars``.

    ``turns`` needs ``conv_id, turn, role, text``; other columns are not looked at. ``part`` counts from 0 in steps of
    ``part_turns`` turns, so that a row stays small whatever the dialogue; parts joined in order are the
    dialogue. ``mask`` lists (start, end) of the characters to learn from, counted from the part's start, end
    excluded. Turns are ordered by ``turn``, then role and text; repeated rows stay. A NULL
    turn comes first, a NULL role speaks as ``unknown``, a NULL text is empty. Rows without ``conv_id`` are one dialogue.
    A dialogue of the system alone has no viewer and no row.
    """
    said = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # Turns are dealt in their order over all tasks, a long dialogue over many; each chunk counts its own turns and adds
    # those of the dialogue's earlier chunks: one row a chunk, so it may be broadcast. Chunks are written once, as
    # their borders come from a sample.
    order = [F.asc_nulls_first("turn"), "role", "text"]
    dealt = said.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    chunks = materialise(dealt.withColumn("chunk", F.spark_partition_id()), "turns")
    local = F.row_number().over(Window.partitionBy("chunk", "conv_id").orderBy(*order)) - 1
    counted = with_carried(chunks.withColumn("local", local), chunk_totals(chunks, ["conv_id"], F.lit(1), "before"), ["conv_id"])
    place = (F.col("local") + F.coalesce("before", F.lit(0))).cast("bigint")
    numbered = counted.withColumn("place", place).withColumn("part", F.floor(F.col("place") / part_turns).cast("bigint"))
    viewers = chunks.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("conv"), F.col("role").alias("perspective")).distinct()
    # a part is gathered once, then written for every viewer
    parts = numbered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "turn", "role", "text"))).alias("turns"))
    seen = parts.join(viewers, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    pieces = F.transform("turns", lambda t: F.struct(
        opening(t["role"], F.col("perspective")).alias("open"), F.concat(t["text"], F.lit(CLOSING)).alias("said"),
        (t["role"] == F.col("perspective")).alias("learn"),
    ))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["open"])
        end = begin + F.length(p["said"])
        span = F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
        return F.struct(end.cast("bigint").alias("at"), F.when(p["learn"], F.array_append(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    written = seen.withColumn("pieces", pieces)
    return written.select(
        "conv_id", "perspective", "part", F.col("turns")[0]["turn"].alias("first_turn"), F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["open"], p["said"])), "").alias("rendered"),
        F.aggregate("pieces", start, add, lambda acc: acc["mask"]).alias("mask"),
    ).withColumn("n_chars", F.length("rendered").cast("bigint"))

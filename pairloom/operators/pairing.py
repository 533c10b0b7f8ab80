"""Positional pairing, chunks and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ordered import ranked

MISMATCH = "Originals and paraphrases lists must have same length"


def pair_by_position(
    originals: DataFrame,
    rewrites: DataFrame,
    on: Sequence[str] = ("batch_id", "pos"),
    text: str = "text",
    strict: bool = True,
) -> DataFrame:
    """Pairs of texts at the same position of the same batch.

    ``strict`` fails the job if a side has a position that the other lacks;
    otherwise only the common positions are kept.
    """
    left = originals.select(*on, F.col(text).alias("original"), F.lit(True).alias("_l"))
    right = rewrites.select(*on, F.col(text).alias("paraphrase"), F.lit(True).alias("_r"))
    if not strict:
        return left.drop("_l").join(right.drop("_r"), list(on))
    both = left.join(right, list(on), "full_outer")
    complete = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.where(F.when(complete, F.lit(True)).otherwise(F.raise_error(F.lit(MISMATCH)).cast("boolean"))).drop(
        "_l", "_r"
    )


def zip_lists(batches: DataFrame, originals: str, rewrites: str, batch: str = "batch_id") -> DataFrame:
    """Pairs from two array columns of one row per batch."""
    same = F.when(F.size(originals) == F.size(rewrites), F.lit(True)).otherwise(
        F.raise_error(F.lit(MISMATCH)).cast("boolean")
    )
    return (
        batches.where(same)
        .select(batch, F.posexplode(F.arrays_zip(F.col(originals).alias("o"), F.col(rewrites).alias("p"))))
        .select(batch, F.col("pos").cast("bigint").alias("pos"), F.col("col.o").alias("original"), F.col("col.p").alias("paraphrase"))
    )


def next_turn_pairs(turns: DataFrame, first: str = "user", second: str = "assistant") -> DataFrame:
    """Each ``first`` turn of a conversation with the ``second`` turn that follows it."""
    o = turns.where(F.col("role") == first).select("conv_id", "turn", F.col("text").alias("original"))
    p = turns.where(F.col("role") == second).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("paraphrase")
    )
    return o.join(p, ["conv_id", "turn"])


def chunk(items: DataFrame, n: int, batch: str = "batch_id", pos: str = "pos", dense: bool = False) -> DataFrame:
    """Consecutive chunks of ``n`` items of each batch; the last may be shorter.

    With ``dense`` positions (0, 1, 2, ... in each batch) this is arithmetic on
    the row; otherwise the items are numbered first.
    """
    if dense:
        return items.withColumn("chunk_no", F.floor(F.col(pos) / n).cast("bigint"))
    return ranked(items, [batch], [pos], "_rn").withColumn(
        "chunk_no", F.floor((F.col("_rn") - 1) / n).cast("bigint")
    ).drop("_rn")


def restore_order(results: DataFrame, batch: str = "batch_id", pos: str = "pos") -> DataFrame:
    return results.orderBy(batch, pos)

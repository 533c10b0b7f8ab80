"""Joins of many rows to a table with one row per key, with hot keys salted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import cut

SALTS = 64
HOT_SHARE = 0.005  # a key above this share of the rows is hot: at most 200 of them
HOT_SAMPLED = 30  # fewer sampled rows than this say nothing


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE, sample: float = 0.01) -> DataFrame:
    """Keys that hold more than ``share`` of a sample of the rows.

    At most 1/share keys can pass, so the result may be broadcast. The choice
    only steers the salting; it has no effect on results as long as both sides
    of a join see the same one, so it is materialised.
    """
    sampled = rows.select(key).sample(sample, 17)
    least = max(share * sampled.count(), HOT_SAMPLED)
    return cut(sampled.groupBy(key).count().where(F.col("count") > least).select(key))


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    hot: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """``rows`` joined to ``table`` (unique ``key``) by left, inner, semi or anti join.

    Adaptive execution splits skewed partitions of the plain join by itself.
    With ``hot`` (see :func:`hot_keys`) rows of those keys are also spread over
    ``salts`` partitions, and only their table rows are repeated. The salt is
    a hash of the row, so a task that runs again sends its rows the same way.
    """
    if hot is None:
        return rows.join(table, key, how)
    marked = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    hashable = [f.name for f in rows.schema if f.dataType.typeName() not in ("map", "variant")]
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")).otherwise(0)
    salted = rows.join(marked, key, "left").withColumn("_salt", spread).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = table.join(marked, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")

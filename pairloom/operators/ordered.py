"""Ordered work on keys of any size.

A window partitioned by a key puts all rows of that key into one task. The
helpers here range-partition on (key, order) instead, so a key that holds a
third of the table is spread over a third of the partitions, and then add what
little has to cross the partition borders. At most one key can continue from
one chunk into the next, so every carried table has at most one row per chunk:
it is bounded by the number of partitions, not by the data, and is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import cut

ROW_IN_CHUNK = (1 << 33) - 1  # monotonically_increasing_id keeps the row in its low 33 bits


def micros(df: DataFrame, name: str) -> Column:
    """Event time as integer microseconds (session time zone UTC)."""
    kind = dict(df.dtypes)[name]
    col = F.col(name)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(col.cast("timestamp"))
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return col.cast("bigint") * 1_000_000
    return F.round(col * 1_000_000).cast("bigint")


NO_KEY = "\x00"  # stands for a NULL key where keys are compared in Python


def key_text(name: str) -> Column:
    """The key as text; NULL is a key like any other."""
    return F.coalesce(F.col(name).cast("string"), F.lit(NO_KEY)).alias("k")


def key_back(df: DataFrame, name: str) -> Column:
    """The key in the type it has in ``df``."""
    return F.nullif(F.col("k"), F.lit(NO_KEY)).cast(df.schema[name].dataType).alias(name)


def whole(cost: Column) -> Column:
    """A cost in whole units; one with a fraction raises, as it cannot be counted exactly."""
    wrong = F.raise_error(F.concat(F.lit("cost must be a whole number: "), cost.cast("string")))
    return F.when(cost == F.floor(cost), cost.cast("bigint")).when(cost.isNotNull(), wrong.cast("bigint"))


def with_carried(chunks: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the values carried into a chunk: at most one row per chunk,
    so they are broadcast. NULL keys match."""
    names = {c: f"_r_{c}" for c in [*keys, "chunk"]}
    right = F.broadcast(carried.withColumnsRenamed(names))
    match = F.lit(True)
    for c, r in names.items():
        match = match & F.col(c).eqNullSafe(F.col(r))
    return chunks.join(right, match, "left").drop(*names.values())


def sorted_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows range-partitioned and sorted on keys + order, with ``chunk``, ``idx``.

    The result is checkpointed: range borders come from a sample, so the chunks
    must not be computed twice.
    """
    cols = [*keys, *order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return cut(
        placed.withColumn("chunk", F.spark_partition_id()).withColumn(
            "idx", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_IN_CHUNK))
        )
    )


def chunk_totals(chunks: DataFrame, keys: Sequence[str], value: Column, alias: str) -> DataFrame:
    """Per key and chunk, the sum of ``value`` over the earlier chunks of the key."""
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunks.groupBy(*keys, "chunk").agg(F.sum(value).alias("_s"))
    carried = sums.withColumn(alias, F.sum("_s").over(before)).drop("_s")
    return carried.where(F.col(alias) > 0)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """``row_number`` over (partition by keys order by order) without hot tasks."""
    grouped = list(keys)
    if not grouped:
        df, grouped = df.withColumn("_all", F.lit(0)), ["_all"]
    chunks = sorted_chunks(df, grouped, order)
    carried = chunk_totals(chunks, grouped, F.lit(1), "_before")
    local = F.row_number().over(Window.partitionBy("chunk", *grouped).orderBy(*order))
    if not keys:
        # one group: the position in the chunk is already the local number
        local = F.col("idx") + 1
    out = with_carried(chunks.withColumn("_local", local), carried, grouped)
    number = (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).cast("bigint")
    return out.withColumn(name, number).drop("_local", "_before", "chunk", "idx", "_all")


def neighbours(chunks: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """Adds ``prev`` and ``next``: the nearest non-NULL ``value`` strictly before
    and after each row among the rows of its key.

    ``chunks`` comes from :func:`sorted_chunks` on the same keys and order.
    """
    valued = chunks.withColumn("_v", value)
    place = F.when(F.col("_v").isNotNull(), F.col("idx"))
    edges = valued.groupBy(*keys, "chunk").agg(F.min_by("_v", place).alias("_low"), F.max_by("_v", place).alias("_high"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        edges.withColumn("_before", F.last("_high", ignorenulls=True).over(earlier))
        .withColumn("_after", F.last("_low", ignorenulls=True).over(later))
        .drop("_low", "_high")
        .where(F.col("_before").isNotNull() | F.col("_after").isNotNull())
    )
    inside = Window.partitionBy("chunk", *keys)
    up = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = inside.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    near = valued.withColumn("prev", F.last("_v", ignorenulls=True).over(up)).withColumn(
        "next", F.last("_v", ignorenulls=True).over(down)
    )
    return (
        with_carried(near, carried, keys)
        .withColumns({"prev": F.coalesce("prev", "_before"), "next": F.coalesce("next", "_after")})
        .drop("_v", "_before", "_after")
    )

"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size. The shards take turns,
each claiming its next free slot, until the table is full. A row's key is hashed to a slot, and the slot
names the shard. Shards so get equally many slots, and when one leaves, most others' slots stay theirs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A prime well above a hundred slots a shard for some hundred shards. The table has a row of two numbers a slot: its size bounds
# what is broadcast.
SLOTS = 65_537
MAX_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot.

    A shard's preferences start at an offset and go on by a step, both from its name; as the table's size is prime,
    every step visits every slot. Names must differ; equal names would claim the same slots.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, one at least")
    if not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    at, step = [], []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(h[:8], "big") % slots)
        step.append(int.from_bytes(h[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1)
    held, free = [-1] * slots, slots
    while free:
        for s in range(len(shards)):
            while held[at[s]] >= 0:
                at[s] = (at[s] + step[s]) % slots
            held[at[s]] = s
            free -= 1
            if not free:
                break
    return held


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The filled table as rows ``slot, shard, shard_name``; ``slots`` rows, so small enough to broadcast."""
    held = fill(shards, slots)
    names = F.array(*[F.lit(n) for n in shards])
    packed = F.split(F.lit(",".join(map(str, held))), ",")
    rows = spark.range(1).select(F.posexplode(packed).alias("slot", "shard"))
    return rows.select(F.col("slot").cast("bigint").alias("slot"), F.col("shard").cast("int").alias("shard")).withColumn("shard_name", names[F.col("shard")])


def slot_of(key: Column, row: list[str], slots: int) -> Column:
    """The slot of a key; a NULL key is placed by the whole row, so that such rows spread."""
    return F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*row)), F.lit(slots)).cast("bigint")


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot``, ``shard`` and ``shard_name``.

    Equal keys share a shard. All rows stay, repeated ones and NULL keys too (those spread by the whole
    row); columns named as the new ones are replaced. One broadcast of the table, no shuffle of ``rows``.
    """
    kept = rows.select(*[c for c in rows.columns if c not in ("slot", "shard", "shard_name")])
    plain = [c for c, t in kept.dtypes if "map<" not in t and "variant" not in t]
    slotted = kept.withColumn("slot", slot_of(F.col(key), plain, slots))
    return slotted.join(F.broadcast(lookup(rows.sparkSession, shards, slots)), "slot").select(*kept.columns, "slot", "shard", "shard_name")


def write(placed: DataFrame, path: str) -> None:
    """One folder a shard; each task writes its own rows, so a shard of any size has many writers."""
    placed.write.partitionBy("shard").parquet(path)

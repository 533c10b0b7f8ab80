"""Admission by fixed windows, batch cost, cache replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.operators.bucket import TOKEN, admit_by_bucket
from pairloom.operators.ordered import key_back, key_text, micros, neighbours, ranked, sorted_chunks, whole
from pairloom.session import cut


def batch_cost(n_texts: Column) -> Column:
    """Request cost of a batch: its size, at most ten."""
    return F.least(n_texts, F.lit(C.MAX_REQUEST_COST))


def fixed_window_admit(
    requests: DataFrame, key: str, ts: str, tie: str, limit: int, seconds: int, cost: Column | None = None
) -> DataFrame:
    """Admit per key and epoch-aligned window while the used cost fits the limit.

    With unit cost the first ``limit`` requests of a window pass. With other
    costs a refused request uses nothing and a later, cheaper one may pass: a
    bucket of ``limit`` tokens per window that never refills.
    """
    width = seconds * 1_000_000
    rows = requests.select(
        F.col(key).alias(key), micros(requests, ts).alias("ts_us"), F.col(tie).alias(tie),
        (F.lit(1).cast("bigint") if cost is None else whole(cost)).alias("cost"),
    ).withColumn("window_no", F.floor(F.col("ts_us") / width).cast("bigint"))
    if cost is None:
        decided = ranked(rows, [key, "window_no"], ["ts_us", tie], "rn").withColumn(
            "admitted", F.col("rn") <= limit
        )
    else:
        keyed = rows.select(
            F.to_json(F.struct(key, "window_no")).alias("k"),
            F.col("ts_us").alias("t"),
            F.col(tie).alias("id"),
            (F.col("cost") * TOKEN).alias("cost"),
            F.lit(limit * TOKEN).cast("bigint").alias("cap"),
            F.lit(0).cast("bigint").alias("rate"),
        )
        verdict = admit_by_bucket(keyed).select(
            F.get_json_object("k", f"$.{key}").cast(dict(rows.dtypes)[key]).alias(key),
            F.col("t").alias("ts_us"),
            F.col("id").alias(tie),
            (F.col("cost") / TOKEN).cast("bigint").alias("cost"),
            "admitted",
        )
        decided = verdict.withColumn("window_no", F.floor(F.col("ts_us") / width).cast("bigint"))
    wait = ((F.col("window_no") + 1) * width - F.col("ts_us")) / 1e6
    return decided.select(
        key, "ts_us", tie, "cost", "window_no", "admitted",
        F.when(F.col("admitted"), F.lit(0.0)).otherwise(wait).alias("retry_after"),
    )


def replay_cache(requests: DataFrame, key: str, ts: str, tie: str, ttl: float = C.MEMO_TTL_SECONDS) -> DataFrame:
    """Mark each request hit or miss of a cache that keeps an entry for ``ttl``.

    A miss at t writes an entry that lives up to and including t + ttl; hits do
    not extend it. So the misses of a key form a chain: the next one is the
    first request later than the last one + ttl. Every request gets a pointer
    to that successor, and chains are followed from all their starts at once by
    doubling the pointers: the number of rounds is the logarithm of the longest
    chain between two idle spells, and no step gathers a key.
    """
    life = round(ttl * 1_000_000)
    rows = requests.select(key_text(key), micros(requests, ts).alias("t"), F.col(tie).alias("id"))
    # Only the first request of an instant can miss. Each instant is a point,
    # and a probe at the end of the life of an entry written by it.
    instants = rows.groupBy("k", "t").agg(F.min("id").alias("id"))
    events = instants.select("k", F.col("t").alias("x"), F.lit(0).alias("probe"), "t", "id").unionByName(
        instants.select("k", (F.col("t") + life).alias("x"), F.lit(1).alias("probe"), "t", "id")
    )
    order = ["x", "probe", "t"]
    point = F.when(F.col("probe") == 0, F.struct(F.col("x").alias("t"), "id"))
    near = neighbours(sorted_chunks(events, ["k"], order), ["k"], order, point)
    # A start has nothing in the ttl before it: whatever was there has expired.
    start = (F.col("probe") == 0) & (F.col("prev").isNull() | (F.col("t") - F.col("prev.t") > life))
    # A successor that is a start is reached anyway: chains end before it.
    linked = (F.col("probe") == 1) & F.col("next").isNotNull() & (F.col("next.t") - F.col("prev.t") <= life)
    # probe 0: a known miss; probe 1: a link from an instant to its successor.
    links = cut(near.where(start | linked).select("k", "t", "id", "probe", "next"))
    while True:
        misses, jump = links.where("probe = 0"), links.where("probe = 1")
        if jump.isEmpty():
            break
        reached = misses.select("k", "t").join(jump, ["k", "t"]).select("k", "next.t", "next.id")
        far = jump.select("k", F.col("t").alias("_at"), F.col("next").alias("_far"))
        onward = jump.withColumn("_at", F.col("next.t")).join(far, ["k", "_at"])
        known = misses.select("k", "t", "id").unionByName(reached).distinct()
        links = cut(
            known.select("k", "t", "id", F.lit(0).alias("probe"), F.lit(None).cast(jump.schema["next"].dataType).alias("next"))
            .unionByName(onward.select("k", "t", "id", "probe", F.col("_far").alias("next")))
        )
    missed = misses.select("k", "id", F.lit(False).alias("_hit"))
    return rows.join(missed, ["k", "id"], "left").select(
        key_back(requests, key), F.col("t").alias("ts_us"), F.col("id").alias(tie),
        F.coalesce("_hit", F.lit(True)).alias("hit"),
    )

"""Admission and duplicate suppression on unbounded request streams.

Each micro-batch is judged by the batch operators, which split a key of any size over many chunks. What a
limiter remembers of earlier micro-batches lies in a table, one folder per micro-batch, as *old requests*: requests that
bring a fresh limiter into the remembered state. They sort before the new requests of their key and are judged
with them, so state and requests need no join and no group. A request older than the last one judged
for its key, or than the watermark, is ``late``: it is passed on with NULL decisions, not dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.operators.admission import replay_cache
from pairloom.operators.bucket import TOKEN, admit_by_bucket, level_units, refill_units
from pairloom.operators.carried import SlidingWindow, admit_in_order
from pairloom.operators.ordered import key_back, key_text, micros, neighbours, sorted_chunks, whole
from pairloom.operators.store import EpochLog, numbered
from pairloom.session import cut

# Old requests have numbers below those of any request, so that they come first at their instant.
OLD, MARK = -(1 << 63), -(1 << 63) + 1
STATE = "k string, t bigint, id bigint, cost bigint"


def is_old() -> Column:
    return F.col("id") <= MARK


class Admission:
    """A limiter over a stream: start it at a folder, read its decisions from there.

    ``judge`` decides requests (k, t, id, cost), old ones among them; ``state_of`` makes the old requests of the next
    micro-batch from what was judged, given the watermark. Both see the rows of one micro-batch and the state, in any
    number of tasks. Requests need a tie-breaking number; equal times go by it.
    """

    def __init__(
        self, stream: DataFrame, key: str, ts: str, tie: str, cost: Column, delay: str,
        judge: Callable[[DataFrame], DataFrame], state_of: Callable[[DataFrame, Column], DataFrame], decisions: dict[str, str],
    ):
        self.stream, self.key, self.ts, self.tie, self.cost = stream, key, ts, tie, cost
        self.judge, self.state_of, self.decisions = judge, state_of, decisions
        epoch = F.lit(0).cast("timestamp") + F.expr(f"INTERVAL {delay}")
        self.delay = stream.sparkSession.range(1).select(F.unix_micros(epoch)).first()[0]

    def step(self, path: str, rows: DataFrame, epoch: int) -> None:
        """Judge a micro-batch; run again under its number it starts from the same state and replaces what it wrote."""
        spark = rows.sparkSession
        log, clock = EpochLog(spark, f"{path}/state"), EpochLog(spark, f"{path}/clock")
        before = log.last(epoch)
        log.forget(before), clock.forget(before)
        state = log.read(before, STATE)
        known = clock.read(before, "high bigint")
        high = known.first().high if known is not None else None
        new = rows.select(
            key_text(self.key), micros(rows, self.ts).alias("t"), F.col(self.tie).cast("bigint").alias("id"), self.cost.cast("bigint").alias("cost"),
        )
        both = new if state is None else new.unionByName(state)
        near = neighbours(sorted_chunks(both, ["k"], ["t", "id"]), ["k"], ["t", "id"], F.when(is_old(), F.col("t")))
        # an old request after a new one: its key was already judged at a later time
        late = ~is_old() & (F.col("next").isNotNull() | (F.col("t") < (F.lit(None) if high is None else F.lit(high - self.delay))))
        marked = cut(near.select("k", "t", "id", "cost", F.coalesce(late, F.lit(False)).alias("late")))
        judged = cut(self.judge(marked.where(~F.col("late")).drop("late")).withColumn("chunk", F.spark_partition_id()))
        decided = judged.where(~is_old()).select("k", "t", "id", *self.decisions, F.lit(False).alias("late"))
        passed = marked.where("late").select("k", "t", "id", *[F.lit(None).cast(kind).alias(c) for c, kind in self.decisions.items()], "late")
        shown = decided.unionByName(passed).select(
            key_back(rows, self.key), F.col("t").alias("ts_us"), F.col("id").alias(self.tie), *self.decisions, "late",
        )
        shown.write.mode("overwrite").parquet(f"{path}/rows/batch={epoch}")
        seen = marked.where(~F.col("late")).agg(F.max("t")).first()[0]
        high = max((x for x in (high, seen) if x is not None), default=None)
        line = F.lit(None if high is None else high - self.delay).cast("bigint")
        log.write(self.state_of(judged, line).select("k", "t", "id", "cost"), epoch)
        clock.write(spark.createDataFrame([(high,)], "high bigint"), epoch)

    def start(self, path: str, available_now: bool = True):
        writer = self.stream.writeStream.foreachBatch(partial(self.step, path)).option("checkpointLocation", f"{path}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def read(self, path: str) -> DataFrame:
        """The decisions written so far."""
        spark: SparkSession = self.stream.sparkSession
        kinds = {self.key: self.stream.schema[self.key].dataType.simpleString(), "ts_us": "bigint", self.tie: "bigint", **self.decisions, "late": "boolean"}
        schema = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())
        if not numbered(spark, f"{path}/rows", "batch="):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows").select(*kinds)

    def run(self, path: str) -> DataFrame:
        """Judge everything that is there now."""
        self.start(path).awaitTermination()
        return self.read(path)


def stream_token_bucket(
    stream: DataFrame, key: str, ts: str, tie: str, capacity: float, refill: float,
    cost: Column | None = None, delay: str = "1 hour",
) -> Admission:
    """``token_bucket_admit`` on a stream: ``admitted``, ``retry_after`` and ``late`` per request.

    The state of a key is one old request that takes from a full bucket what is missing. A key whose bucket is full by the
    watermark is forgotten.
    """
    cap, rate = level_units(capacity), refill_units(refill)

    def judge(rows: DataFrame) -> DataFrame:
        decided = admit_by_bucket(rows.withColumns({"cap": F.lit(cap).cast("bigint"), "rate": F.lit(rate).cast("bigint")}))
        return decided.withColumn("retry_after", F.col("retry_us") / 1e6)

    def state_of(judged: DataFrame, line: Column) -> DataFrame:
        last = judged.groupBy("k").agg(F.max("t").alias("t"), F.max_by("level", F.struct("t", "id")).alias("level"))
        missing = F.lit(cap) - F.col("level")
        # waits are compared in microseconds, which do not overflow
        full = (missing == 0) | (F.lit(rate) > 0) & (F.ceil(missing / F.lit(max(rate, 1))) <= line - F.col("t"))
        gone = F.coalesce((F.col("t") <= line) & full, F.lit(False))
        return last.where(~gone).select("k", "t", F.lit(OLD).alias("id"), missing.alias("cost"))

    price = F.lit(TOKEN) if cost is None else F.round(cost * TOKEN)
    return Admission(stream, key, ts, tie, price, delay, judge, state_of, {"admitted": "boolean", "retry_after": "double"})


def stream_sliding_admit(
    stream: DataFrame, key: str, ts: str, tie: str, limit: int, seconds: float,
    cost: Column | None = None, delay: str = "1 hour",
) -> Admission:
    """``sliding_window_admit`` on a stream; costs must be whole numbers.

    The state of a key are its admitted requests inside the window before its last request, and a mark at that request. A key
    is forgotten when the watermark is a window beyond its last request.
    """
    window = round(seconds * 1_000_000)

    def judge(rows: DataFrame) -> DataFrame:
        return admit_in_order(rows, SlidingWindow(limit, window)).withColumn("retry_after", F.col("retry_us") / 1e6)

    def state_of(judged: DataFrame, line: Column) -> DataFrame:
        last = judged.groupBy("k").agg(F.max("t").alias("last")).where(F.coalesce(F.col("last") + window > line, F.lit(True)))
        # What is a window older than another request of its chunk goes first: at most ``limit`` rows a key and chunk are joined.
        near = judged.withColumn("_near", F.max("t").over(Window.partitionBy("chunk", "k"))).where(F.col("admitted") & (F.col("cost") > 0) & (F.col("t") > F.col("_near") - window))
        live = near.join(last, "k").where(F.col("t") > F.col("last") - window).select("k", "t", F.lit(OLD).alias("id"), "cost")
        return live.unionByName(last.select("k", F.col("last").alias("t"), F.lit(MARK).alias("id"), F.lit(0).cast("bigint").alias("cost")))

    price = F.lit(1) if cost is None else whole(cost)
    return Admission(stream, key, ts, tie, price, delay, judge, state_of, {"admitted": "boolean", "retry_after": "double"})


def stream_dedupe_ttl(
    stream: DataFrame, key: str, ts: str, tie: str, ttl: float = C.MEMO_TTL_SECONDS, delay: str = "1 hour"
) -> Admission:
    """Marks requests (``hit``) whose key was answered at most ``ttl`` seconds ago.

    The state of a key is the request that was answered last, and a mark at its last request. A key is forgotten when the
    watermark has passed the end of that answer's life.
    """
    life = round(ttl * 1_000_000)

    def judge(rows: DataFrame) -> DataFrame:
        marked = replay_cache(rows.withColumn("at", F.timestamp_micros("t")), "k", "at", "id", ttl)
        return marked.withColumnRenamed("ts_us", "t")

    def state_of(judged: DataFrame, line: Column) -> DataFrame:
        last = judged.groupBy("k").agg(F.max("t").alias("last"), F.max(F.when(~F.col("hit"), F.col("t"))).alias("answered"))
        kept = last.where(F.coalesce(F.col("answered") + life >= line, F.lit(True)))
        none = F.lit(0).cast("bigint").alias("cost")
        answered = kept.select("k", F.col("answered").alias("t"), F.lit(OLD).alias("id"), none)
        return answered.unionByName(kept.select("k", F.col("last").alias("t"), F.lit(MARK).alias("id"), none))

    return Admission(stream, key, ts, tie, F.lit(0), delay, judge, state_of, {"hit": "boolean"})

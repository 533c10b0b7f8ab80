"""Streaming generation, scoring and summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions.requests import cache_key
from pairloom.operators.evaluate import evaluate_batch
from pairloom.operators.generate import generate, offline_reply
from pairloom.operators.store import EpochLog, ResultsStore, live, new_entries, numbered
from pairloom.operators.summaries import request_metrics
from pairloom.operators.validate import text_violation


def stream_rewrite_and_score(
    texts: DataFrame,
    store: ResultsStore | None = None,
    now: Column | None = None,
    fn: Callable[[str], str | None] = offline_reply,
    text: str = "text",
    operation: str = "generate",
    max_chars: int | None = None,
    **calls,
) -> DataFrame:
    """Validate, look up or generate, and score each text of a stream.

    One pass without a store of its own: texts with a live entry in the store (as it is when the query starts) are
    not generated, new ones are as often as they come (``start_rewrite_and_score`` asks once); invalid texts (NULL, blank, above ``max_chars`` if given) are marked
    and neither generated nor scored.
    Write the result with ``append_parquet`` and add the new ones to the store
    with :func:`remember`.
    """
    rows = texts.withColumn("violation", text_violation(F.col(text), max_chars)).withColumn(
        "key", cache_key({"text": F.col(text)}, operation)
    )
    if store is None:
        rows = rows.withColumn("_known", F.lit(None).cast("string"))
    else:
        known = live(store.read(), now).select("key", F.get_json_object("value", "$.value").alias("_known"))
        rows = rows.join(known, "key", "left")
    # Only what has to be generated reaches the model: the rest is handed NULL.
    todo = F.col("violation").isNull() & F.col("_known").isNull()
    asked = rows.withColumn("_ask", F.when(todo, F.col(text)))
    called = generate(asked, fn, "_ask", **calls).drop("status", "seconds", "_ask")
    answered = called.withColumns({
        "result": F.coalesce("_known", "result"), "cached": F.col("_known").isNotNull()
    }).drop("_known", "attempts")
    scored = evaluate_batch(answered.withColumnRenamed("error", "call_error"), original=text, paraphrase="result")
    return scored


def _asked(rows: DataFrame, text: str, operation: str, max_chars: int | None) -> DataFrame:
    return rows.withColumn("violation", text_violation(F.col(text), max_chars)).withColumn("key", cache_key({"text": F.col(text)}, operation))


def _answered(asked: DataFrame, answers: DataFrame, text: str) -> DataFrame:
    """The rows with their answers (``key``, ``_known``, ``_made``, ``error``) and scores; invalid ones have none."""
    # rows without a text to ask do not meet in the task of one key
    slot = F.when(F.col("violation").isNull(), F.col("key")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    found = asked.withColumn("_slot", slot).join(answers.withColumnsRenamed({"key": "_slot", "error": "call_error"}), "_slot", "left").drop("_slot")
    cached = F.col("_known").isNotNull()
    told = found.withColumns({"result": F.coalesce("_known", "_made"), "cached": cached}).drop("_known", "_made")
    return evaluate_batch(told, original=text, paraphrase="result")


ANSWER = "key string, _known string, _made string, error string"


def start_rewrite_and_score(
    texts: DataFrame,
    store: ResultsStore,
    path: str,
    now: Callable[[], Column] | None = None,
    fn: Callable[[str], str | None] = offline_reply,
    text: str = "text",
    operation: str = "generate",
    max_chars: int | None = None,
    ttl: int | None = C.MEMO_TTL_SECONDS,
    available_now: bool = True,
    **calls,
):
    """Start a query that validates, looks up or generates, stores and scores the texts of a stream.

    Each micro-batch asks the model once for every distinct valid text without a live entry in the store, which
    holds what all earlier micro-batches made, and what other jobs made meanwhile. In this order: (1) its answers are written
    to ``path/answers/epoch=N``; (2) the new ones go to the store; (3) its rows are written to ``path/rows/batch=N``. A
    micro-batch that runs again takes its answers from (1), so it neither asks again nor changes a row, and replaces its
    folders. ``cached`` says that the answer was there before the micro-batch. Failed calls are not stored: their texts are asked
    again when they come again. ``now`` gives the time of a micro-batch, by default the clock's. Read the rows with ``scored_rows``.
    """
    spark = texts.sparkSession
    log = EpochLog(spark, f"{path}/answers")

    def step(rows: DataFrame, epoch: int) -> None:
        at = now() if now else F.current_timestamp()
        asked = _asked(rows, text, operation, max_chars)
        answers = log.read(epoch, ANSWER)
        if answers is None:
            wanted = asked.where(F.col("violation").isNull()).groupBy("key").agg(F.first(text).alias("_text"))
            known = live(store.read(), at).select("key", F.get_json_object("value", "$.value").alias("_known"))
            todo = wanted.join(known, "key", "left").withColumn("_ask", F.when(F.col("_known").isNull(), F.col("_text")))
            made = generate(todo, fn, "_ask", **calls)
            answers = log.write(made.select("key", "_known", F.col("result").alias("_made"), "error"), epoch)
        fresh = answers.where(F.col("_made").isNotNull())
        store.put(new_entries(fresh.select("key", F.to_json(F.struct(F.col("_made").alias("value"))).alias("value")), at, ttl))
        _answered(asked, answers, text).write.mode("overwrite").parquet(f"{path}/rows/batch={epoch}")
        log.forget(epoch)

    writer = texts.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def scored_rows(texts: DataFrame, path: str, text: str = "text", operation: str = "generate") -> DataFrame:
    """The rows that ``start_rewrite_and_score`` has written for the stream ``texts`` so far."""
    spark = texts.sparkSession
    nothing = spark.createDataFrame([], texts.schema)
    shape = _answered(_asked(nothing, text, operation, None), spark.createDataFrame([], ANSWER), text).schema
    if not numbered(spark, f"{path}/rows", "batch="):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).option("basePath", f"{path}/rows").parquet(f"{path}/rows").select(*shape.names)


def remember(scored: DataFrame, store: ResultsStore, now: Column, ttl: int | None = C.MEMO_TTL_SECONDS) -> None:
    """Put the newly generated results of a finished run into the store."""
    fresh = scored.where(~F.col("cached") & F.col("result").isNotNull())
    values = fresh.groupBy("key").agg(F.max("result").alias("value"))
    store.put(new_entries(values.withColumn("value", F.to_json(F.struct("value"))), now, ttl))


def stream_window_usage(
    requests: DataFrame, provider: str, ts: str, seconds: int = 60, slide: int | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Requests per provider and window. In append mode a window comes once the watermark has passed it; with
    ``keep_latest`` all windows are there, the open ones too."""
    width = F.window(ts, f"{seconds} seconds", f"{slide or seconds} seconds").alias("w")
    return (
        requests.withWatermark(ts, delay)
        .groupBy(F.col(provider).alias("provider"), width)
        .agg(F.count("*").alias("n_requests"))
        .select("provider", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_requests")
    )


def stream_summary(
    requests: DataFrame, failed: Column, seconds: Column, hit: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Running request metrics; write with ``keep_latest``."""
    return request_metrics(requests, failed, seconds, hit, by)

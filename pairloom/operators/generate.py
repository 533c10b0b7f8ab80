"""Model calls: retried map, classification, routing, memoised map, retry passes.

A model is a Python callable ``text -> reply``. Calls are slow, may cost money
and need not give the same reply twice, so their results are written to a
store or table before anything reads them a second time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions.requests import (
    backoff_delay, build_prompt, cache_key, canonical_provider, normalize_label, result_status,
)
from pairloom.operators.lookup import lookup
from pairloom.operators.providers import resolve_model
from pairloom.operators.store import ResultsStore, live, new_entries
from pairloom.session import scratch_dir, text_parts

CALL_COLUMNS = "result string, attempts int, error string, seconds double"
SLICE_CHARS = 2 << 20  # of texts whose replies are handed on together
CALL_NAMES = ["result", "attempts", "error", "seconds"]


def offline_reply(text: str) -> str:
    """Stands in for a model where none is configured."""
    return C.OFFLINE_REPLY_PREFIX + text


def call_with_retries(fn: Callable, args: tuple, max_retries: int, delay: float) -> tuple:
    """(result, attempts, error, seconds); the result of a failed call is None. NULL is not called."""
    if args[0] is None:
        return None, 0, None, 0.0
    began = time.perf_counter()
    error = None
    for attempt in range(max_retries + 1):
        try:
            return fn(*args), attempt + 1, None, time.perf_counter() - began
        except Exception as e:  # noqa: BLE001 - one row's failure must not end the job
            error = f"{type(e).__name__}: {e}"
            if delay > 0 and attempt < max_retries:
                time.sleep(delay * 2**attempt)
    return None, max_retries + 1, error, time.perf_counter() - began


def call_list(fn: Callable, texts: list[str | None], rest: tuple = (), max_retries: int = C.MAX_RETRIES, delay: float = C.RETRY_DELAY) -> list[tuple]:
    """(result, attempts, error, seconds) of every text, from calls with lists of texts.

    A list whose call raises, or gives another number of replies than it has texts, is halved and the halves are asked on their
    own, down to single texts, which are retried. So each text has its own result or error, as if it had been asked alone,
    and f bad texts among n cost about 2 f log n calls. ``attempts`` counts the calls of the list that gave the outcome.
    """
    def whole(part: list[str], *rest):
        replies = fn(part, *rest)
        if len(replies) != len(part):
            raise ValueError(f"{len(replies)} replies to {len(part)} texts")
        return replies

    out: list[tuple] = [(None, 0, None, 0.0)] * len(texts)
    asked = [i for i, t in enumerate(texts) if t is not None]
    waiting = [asked] if asked else []
    while waiting:
        part = waiting.pop()
        replies, attempts, error, seconds = call_with_retries(whole, ([texts[i] for i in part], *rest), max_retries if len(part) == 1 else 0, delay)
        if error is None:
            for i, reply in zip(part, replies, strict=True):
                out[i] = (reply, attempts, None, seconds / len(part))
        elif len(part) == 1:
            out[part[0]] = (None, attempts, error, seconds)
        else:
            if delay > 0:
                time.sleep(delay)
            waiting += [part[len(part) // 2 :], part[: len(part) // 2]]
    return out


def some_at_once(batches: Iterator[pd.Series], step: int) -> Iterator[list[str | None]]:
    """The texts in lists of whole steps with about ``SLICE_CHARS`` characters, so that replies are held for a bounded size of texts."""
    for some in batches:
        texts = some.tolist()
        begin = size = 0
        for i in range(0, len(texts), step):
            size += sum(len(t) for t in texts[i : i + step] if t is not None)
            if size >= SLICE_CHARS:
                yield texts[begin : i + step]
                begin, size = i + step, 0
        if begin < len(texts):
            yield texts[begin:]


def called(rows: DataFrame, calls: Callable, *inputs: Column) -> DataFrame:
    """``rows`` with the columns of ``calls``, a function over batches of the inputs; only these go through Python.

    The function counts as nondeterministic, so that the optimizer keeps one evaluation of it whatever is taken from its results.
    """
    made = F.pandas_udf(calls, CALL_COLUMNS).asNondeterministic()
    return rows.withColumn("_call", made(*inputs)).select(*rows.columns, "_call.*")


def generate(
    df: DataFrame,
    fn: Callable = offline_reply,
    text: str = "text",
    max_retries: int = C.MAX_RETRIES,
    retry_delay: float = C.RETRY_DELAY,
    setup: Callable[[], Callable] | None = None,
    parallel: int | None = None,
    batch: int | None = None,
) -> DataFrame:
    """Adds result, attempts, error, seconds and status to each row; columns with these names are replaced.

    ``fn`` takes a text and gives a reply; with ``batch`` it takes a list of at most so many texts and gives as many replies (see
    ``call_list``). ``setup`` makes the callable once per task (a client, a loaded model). ``parallel`` sets the number of
    tasks and so bounds simultaneous calls.
    """
    def calls(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = setup() if setup is not None else fn
        for texts in some_at_once(batches, batch or 1):
            if batch is None:
                made = [call_with_retries(call, (t,), max_retries, retry_delay) for t in texts]
            else:
                made = [r for i in range(0, len(texts), batch) for r in call_list(call, texts[i : i + batch], (), max_retries, retry_delay)]
            yield pd.DataFrame(made, columns=CALL_NAMES)

    rows = df.drop(*CALL_NAMES) if text not in CALL_NAMES else df.drop(*[c for c in CALL_NAMES if c != text])
    rows = rows.repartition(parallel) if parallel else rows
    return called(rows, calls, F.col(text)).withColumn("status", result_status(F.col("result")))


def classify(df: DataFrame, fn: Callable[[str], str | None], text: str = "text", **calls) -> DataFrame:
    """Adds ``label`` ('0', '1' or NULL) from the reply to the labelling prompt."""
    asked = df.withColumn("prompt", build_prompt(F.col(text), "classify"))
    replied = generate(asked, fn, "prompt", **calls)
    return replied.withColumn("label", normalize_label(F.col("result"))).drop("prompt")


def routed_calls(registry: Mapping[str, Callable], max_retries: int, delay: float, batch: int | None) -> Callable:
    """A function over batches of (route, model name, text) that asks each route's callable.

    With ``batch`` a callable takes (texts, model name), else (text, model name). Lists are filled with the texts of one route
    and model of a whole Arrow batch. A route without a callable has no attempts and no error.
    """
    known = dict(registry)

    def calls(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for routes, names, texts in batches:
            body = texts.tolist()
            made: list[tuple] = [(None, 0, None, 0.0)] * len(body)
            alike: dict[tuple, list[int]] = {}
            for i, (route, name) in enumerate(zip(routes.tolist(), names.tolist(), strict=True)):
                if route in known and body[i] is not None:
                    alike.setdefault((route, name), []).append(i)
            for (route, name), places in alike.items():
                for start in range(0, len(places), batch or 1):
                    some = places[start : start + (batch or 1)]
                    if batch is None:
                        replies = [call_with_retries(known[route], (body[some[0]], name), max_retries, delay)]
                    else:
                        replies = call_list(known[route], [body[i] for i in some], (name,), max_retries, delay)
                    for i, reply in zip(some, replies, strict=True):
                        made[i] = reply
            yield pd.DataFrame(made, columns=CALL_NAMES)

    return calls


def fixed_messages(registry: Mapping[str, Callable], route: Column, reply: Column, error: Column) -> Column:
    """The reply, or the message for a provider without a callable, a failed call, a missing or empty reply."""
    return (
        F.when(~F.coalesce(route.isin(*registry), F.lit(False)), F.lit(C.UNKNOWN_PROVIDER))
        .when(error.isNotNull(), F.lit(C.CALL_FAILED))
        .otherwise(F.coalesce(F.nullif(reply, F.lit("")), F.lit(C.NO_RESULT)))
    )


def dispatch(
    df: DataFrame,
    registry: Mapping[str, Callable],
    provider: str = "provider",
    model: str = "model",
    text: str = "text",
    settings: DataFrame | None = None,
    batch: int | None = None,
) -> DataFrame:
    """Route each row to its provider's callable ``(text, model name) -> reply``, or with ``batch`` ``(texts, model name) -> replies``.

    The reply is always a text: a missing reply, a failing call and a provider
    without a callable have fixed messages. A text whose call fails leaves the others of its list as they are.
    """
    routed = resolve_model(df, provider, model, settings).withColumn("_route", canonical_provider(F.col(provider)))
    routed = routed.drop(*[c for c in CALL_NAMES if c != text])
    replied = called(routed, routed_calls(registry, 0, 0, batch), F.col("_route"), F.col("model_name"), F.col(text))
    said = fixed_messages(registry, F.col("_route"), F.col("result"), F.col("error"))
    out = replied.withColumn("result", said).drop("_route", "attempts", "error", "seconds")
    return out.withColumn("status", result_status(F.col("result")))


def memoized_dispatch(
    df: DataFrame,
    registry: Mapping[str, Callable[[list[str], str], list[str | None]]],
    store: ResultsStore,
    now: Column,
    provider: str = "provider",
    model: str = "model",
    text: str = "text",
    settings: DataFrame | None = None,
    ttl: int | None = C.MEMO_TTL_SECONDS,
    max_retries: int = C.MAX_RETRIES,
    retry_delay: float = C.RETRY_DELAY,
    batch: int = C.MAX_REQUEST_TEXTS,
    operation: str = "dispatch",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Adds ``key, model_name, result, attempts, error, cached, status``: routed, memoised and retried in one.

    A provider's callable takes a list of at most ``batch`` texts and a model name and returns as many replies; a failing list
    is taken apart until only the bad texts fail (``call_list``). Each distinct (provider, model, text) without a live entry is
    asked once; replies are stored, fixed messages for a missing reply, a failed call and an unknown provider are not. NULL
    texts are not asked and have a NULL result. ``attempts`` is 0 for what was not asked. The store is read once; ``hot`` names
    keys (see ``hot_keys``) whose rows are spread over several tasks when the answers come back.
    """
    routed = resolve_model(df, provider, model, settings).withColumn("_route", canonical_provider(F.col(provider)))
    key = cache_key({"text": F.col(text), "provider": F.col("_route"), "model": F.col("model_name")}, operation)
    keyed = routed.withColumn("key", key)
    wanted = keyed.where(F.col(text).isNotNull()).groupBy("key").agg(*[F.first(c).alias(c) for c in ("_route", "model_name")], F.first(text).alias("_text"))
    known = live(store.read(), now).select("key", F.get_json_object("value", "$.value").alias("_known"))
    todo = F.when(F.col("_known").isNull(), F.col("_text"))
    asked = called(wanted.join(known, "key", "left"), routed_calls(registry, max_retries, retry_delay, batch), F.col("_route"), F.col("model_name"), todo)
    said = fixed_messages(registry, F.col("_route"), F.col("result"), F.col("error"))
    # Paid answers are written before anything reads them twice.
    answers = _written(asked.select("key", "_known", F.when(F.col("_known").isNull(), said).alias("_made"), "attempts", "error"), "answers")
    good = answers.where(F.col("_made").isNotNull() & ~F.col("_made").isin(*C.FALLBACK_REPLIES))
    store.put(new_entries(good.select("key", F.to_json(F.struct(F.col("_made").alias("value"))).alias("value")), now, ttl))
    # NULL texts have no answer: each gets a slot of its own instead of meeting in the task of one key
    slot = F.when(F.col(text).isNotNull(), F.col("key")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    plain = keyed.drop("attempts", "error", "result").withColumn("_slot", slot)
    found = lookup(plain, answers.withColumnRenamed("key", "_slot"), "_slot", "left", None if hot is None else hot.select(F.col("key").alias("_slot")))
    return found.withColumns({
        "result": F.coalesce("_known", "_made"), "attempts": F.coalesce("attempts", F.lit(0)), "cached": F.col("_known").isNotNull(),
    }).withColumn("status", result_status(F.col("result"))).drop("_known", "_made", "_route", "_slot")


def _written(answers: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(answers.sparkSession, label)
    answers.write.parquet(path)
    return answers.sparkSession.read.schema(answers.schema).parquet(path)


def retry_pass(
    df: DataFrame, fn: Callable, key: str, text: str = "text", max_retries: int = C.MAX_RETRIES,
    retry_delay: float = C.RETRY_DELAY,
) -> DataFrame:
    """Retry queue over a whole table: each pass calls the rows that failed.

    Every pass is written before the next reads it; there are at most
    ``max_retries + 1`` passes. ``wait`` is the delay due before the row's last
    attempt; nothing sleeps.
    """
    spark = df.sparkSession
    base = scratch_dir(spark, "retry")
    # joined in partitions of a bounded size: texts and results meet in one task
    parts = text_parts(df, text)
    dealt = df.repartition(parts, key)
    open_rows, done = df, []
    for attempt in range(max_retries + 1):
        path = f"{base}/pass={attempt}"
        called = generate(open_rows.select(key, text), fn, text, max_retries=0).drop("attempts", text)
        called.withColumn("attempt", F.lit(attempt)).write.parquet(path)
        written = spark.read.parquet(path)
        failed = F.col("status") == "failed"
        last = attempt == max_retries
        done.append(written if last else written.where(~failed))
        if last or written.where(failed).isEmpty():
            break
        open_rows = dealt.join(written.where(failed).select(key).repartition(parts, key), key, "left_semi")
    results = done[0]
    for more in done[1:]:
        results = results.unionByName(more)
    waited = F.when(F.col("attempt") > 0, backoff_delay(F.col("attempt") - 1, retry_delay)).otherwise(F.lit(0.0))
    results = results.select(
        key, "result", "status", "error", (F.col("attempt") + 1).alias("attempts"), waited.alias("wait")
    )
    return dealt.join(results.repartition(parts, key), key)


def with_observation(df: DataFrame, fn: Callable = offline_reply, text: str = "text", **calls) -> tuple[DataFrame, Observation]:
    """Generated rows with per-call seconds and errors, and their totals, which
    are there after the first action on the rows."""
    seen = Observation("model calls")
    out = generate(df, fn, text, **calls).observe(
        seen,
        F.count(F.lit(1)).alias("calls"),
        F.count("error").alias("errors"),
        F.sum("seconds").alias("seconds"),
        F.max("seconds").alias("slowest"),
    )
    return out, seen


def memoized_transform(
    df: DataFrame,
    store: ResultsStore,
    now: Column,
    fn: Callable[[str], str | None] = offline_reply,
    operation: str = "generate",
    arguments: tuple[str, ...] = ("text",),
    text: str = "text",
    ttl: int | None = C.MEMO_TTL_SECONDS,
    prefix: str = C.MEMO_PREFIX,
    skip_cache: bool = False,
    hot: DataFrame | None = None,
    **calls,
) -> DataFrame:
    """Adds ``key``, ``result`` and ``cached``; only texts without a live entry
    are generated, each distinct one once, and stored before use.

    The key covers the operation and the ``arguments`` columns. Values are
    stored as JSON strings. ``skip_cache`` neither reads nor writes the store.
    """
    keyed = df.withColumn("key", cache_key({c: F.col(c) for c in arguments}, operation, prefix))
    if skip_cache:
        # Written, so that whatever reads the rows, and how often, each text is called once.
        made = generate(keyed, fn, text, **calls).drop("attempts", "error", "seconds", "status")
        return _written(made, "answers").withColumn("cached", F.lit(False))
    # One row per key before anything else: a text that fills a third of the
    # table is called once and its rows do not meet in one task.
    wanted = keyed.groupBy("key").agg(F.first(text).alias("_text"))
    known = live(store.read(), now).select("key", F.get_json_object("value", "$.value").alias("_known"))
    asked = wanted.join(known, "key", "left").withColumn("_ask", F.when(F.col("_known").isNull(), F.col("_text")))
    made = generate(asked, fn, "_ask", **calls)
    answers = _written(made.select("key", F.coalesce("_known", "result").alias("result"), F.col("_known").isNotNull().alias("cached")), "answers")
    fresh = answers.where(~F.col("cached") & F.col("result").isNotNull())
    store.put(new_entries(fresh.select("key", F.to_json(F.struct(F.col("result").alias("value"))).alias("value")), now, ttl))
    return lookup(keyed.drop("result", "cached"), answers, "key", "left", hot).withColumn("cached", F.coalesce("cached", F.lit(False)))

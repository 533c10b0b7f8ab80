"""Registered queries: admission, cache replay and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.operators import admission as A
from pairloom.operators.bucket import token_bucket_admit
from pairloom.operators.carried import hierarchical_admit, sliding_window_admit
from pairloom.operators.store import ResultsStore
from pairloom.operators.summaries import cache_stats
from pairloom.plans.common import ORACLES, big, query, r6, sql_scores, table
from pairloom.plans.scores import METRICS
from pairloom.session import scratch_dir
from pairloom.streaming import admission as SA
from pairloom.streaming import scoring as SS
from pairloom.streaming.files import read_stream, run_to_latest, run_to_table

K = "json_extract_string(props, '$.k')"


def ordered(key):
    return (
        f"r AS (SELECT {key} AS k, event_id AS id, event_type AS p, epoch_us(ts) AS t, "
        f"row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events)"
    )


def bucket_sql(cap, rate, out):
    cap, rate, cost = round(cap * 10**12), round(rate * 10**6), 10**12
    return f"""
    WITH RECURSIVE {ordered('event_type')},
    f AS (
      SELECT k, id, t, rn, CAST({cap} AS BIGINT) AS before, CAST({cap - cost} AS BIGINT) AS after FROM r WHERE rn = 1
      UNION ALL
      SELECT k, id, t, rn, before, CASE WHEN before >= {cost} THEN before - {cost} ELSE before END FROM (
        SELECT r.k, r.id, r.t, r.rn, least({cap}, f.after + (r.t - f.t) * {rate}) AS before
        FROM f JOIN r ON r.k = f.k AND r.rn = f.rn + 1))
    SELECT k AS event_type, id AS event_id, t AS ts_us, before >= {cost} AS admitted,
      CASE WHEN before >= {cost} THEN 0 ELSE round(({cost} - before) / {rate}.0 / 1e6, 6) END AS retry_after{out} FROM f
    """


W5 = bucket_sql(3, 0.0005, "")


@query("w5_token_bucket_admit", W5)
def _(spark, sf):
    d = token_bucket_admit(table(spark, sf, "events"), "event_type", "ts", "event_id", 3, 0.0005)
    return d.select("event_type", "event_id", "ts_us", "admitted", r6("retry_after").alias("retry_after"))


@query(
    "w3_fixed_window_admit",
    "SELECT event_type, event_id, t AS ts_us, rn <= 9 AS admitted, CASE WHEN rn <= 9 THEN 0 ELSE "
    "((w + 1) * 21600000000 - t) / 1e6 END AS retry_after FROM (SELECT *, row_number() OVER (PARTITION BY event_type, w "
    "ORDER BY t, event_id) AS rn FROM (SELECT event_type, event_id, epoch_us(ts) AS t, epoch_us(ts) // 21600000000 AS w FROM events))",
)
def _(spark, sf):
    d = A.fixed_window_admit(table(spark, sf, "events"), "event_type", "ts", "event_id", 9, 6 * 3600)
    return d.select("event_type", "event_id", "ts_us", "admitted", "retry_after")


@query(
    "w3_fixed_window_admit_weighted",
    """
    WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY k, w ORDER BY t, id) AS rn FROM (
      SELECT event_type AS k, event_id AS id, epoch_us(ts) AS t, epoch_us(ts) // 21600000000 AS w,
        CAST(1 + floor(value / 10) AS BIGINT) AS c FROM events)),
    f AS (
      SELECT k, w, id, t, rn, c, c <= 25 AS admitted, CASE WHEN c <= 25 THEN c ELSE 0 END AS used FROM r WHERE rn = 1
      UNION ALL
      SELECT r.k, r.w, r.id, r.t, r.rn, r.c, f.used + r.c <= 25, CASE WHEN f.used + r.c <= 25 THEN f.used + r.c ELSE f.used END
      FROM f JOIN r ON r.k = f.k AND r.w = f.w AND r.rn = f.rn + 1)
    SELECT k AS event_type, id AS event_id, t AS ts_us, c AS cost, admitted,
      CASE WHEN admitted THEN 0 ELSE ((w + 1) * 21600000000 - t) / 1e6 END AS retry_after FROM f
    """,
)
def _(spark, sf):
    cost = 1 + F.floor(F.col("value") / 10)
    d = A.fixed_window_admit(table(spark, sf, "events"), "event_type", "ts", "event_id", 25, 6 * 3600, cost)
    return d.select("event_type", "event_id", "ts_us", "cost", "admitted", "retry_after")


SIX_HOURS = 21_600_000_000
W4 = f"""
    WITH RECURSIVE {ordered('event_type')},
    f AS (
      SELECT k, id, t, rn, true AS admitted, CAST(0 AS BIGINT) AS retry, [t] AS live FROM r WHERE rn = 1
      UNION ALL
      SELECT k, id, t, rn, len(live) < 9, CASE WHEN len(live) < 9 THEN 0 ELSE live[1] + {SIX_HOURS} - t END,
        CASE WHEN len(live) < 9 THEN list_append(live, t) ELSE live END
      FROM (SELECT r.k, r.id, r.t, r.rn, list_filter(f.live, lambda x: x > r.t - {SIX_HOURS}) AS live
        FROM f JOIN r ON r.k = f.k AND r.rn = f.rn + 1))
    SELECT k AS event_type, id AS event_id, t AS ts_us, admitted, retry / 1e6 AS retry_after FROM f
    """


@query("w4_sliding_window_admit", W4)
def _(spark, sf):
    d = sliding_window_admit(table(spark, sf, "events"), "event_type", "ts", "event_id", 9, 6 * 3600)
    return d.select("event_type", "event_id", "ts_us", "admitted", "retry_after")


@query(
    "w6_hierarchical_admit",
    f"""
    WITH RECURSIVE {ordered('user_id')},
    f AS (
      SELECT k, id, t, rn, p, g0, a0, b0, g0 >= 1e12 AS gok, CASE p WHEN 'click' THEN a0 >= 1e12 WHEN 'view' THEN b0 >= 1e12 ELSE true END AS pok
      FROM (SELECT *, CAST(3e12 AS BIGINT) AS g0, CAST(1e12 AS BIGINT) AS a0, CAST(2e12 AS BIGINT) AS b0 FROM r WHERE rn = 1)
      UNION ALL
      SELECT *, g0 >= 1e12, CASE p WHEN 'click' THEN a0 >= 1e12 WHEN 'view' THEN b0 >= 1e12 ELSE true END FROM (
        SELECT r.k, r.id, r.t, r.rn, r.p,
          CAST(least(3e12, f.g0 - CASE WHEN f.gok AND f.pok THEN 1e12 ELSE 0 END + (r.t - f.t) * 100) AS BIGINT) AS g0,
          CAST(least(1e12, f.a0 - CASE WHEN f.gok AND f.pok AND f.p = 'click' THEN 1e12 ELSE 0 END + (r.t - f.t) * 10) AS BIGINT) AS a0,
          CAST(least(2e12, f.b0 - CASE WHEN f.gok AND f.pok AND f.p = 'view' THEN 1e12 ELSE 0 END + (r.t - f.t) * 20) AS BIGINT) AS b0
        FROM f JOIN r ON r.k = f.k AND r.rn = f.rn + 1))
    SELECT k AS user_id, id AS event_id, gok AND pok AS admitted,
      CASE WHEN NOT gok THEN 'shared' WHEN NOT pok THEN 'provider' END AS refused_by,
      round(CASE WHEN NOT gok THEN (1e12 - g0) / 100 / 1e6 WHEN NOT pok AND p = 'click' THEN (1e12 - a0) / 10 / 1e6
        WHEN NOT pok THEN (1e12 - b0) / 20 / 1e6 ELSE 0 END, 6) AS retry_after FROM f
    """,
)
def _(spark, sf):
    d = hierarchical_admit(
        table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id", (3, 0.0001),
        {"click": (1, 0.00001), "view": (2, 0.00002)},
    )
    return d.select("user_id", "event_id", "admitted", "refused_by", r6("retry_after").alias("retry_after"))


@query(
    "w7_batch_cost",
    "SELECT user_id, n AS n_texts, least(n, 10) AS cost FROM (SELECT user_id, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY ALL)",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    sizes = e.groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n_texts"))
    return sizes.select("user_id", "n_texts", A.batch_cost(F.col("n_texts")).alias("cost"))


# Six days: long enough that most requests of a key follow a live entry.
TTL = 6 * 86_400


def replay_sql(ttl):
    return f"""
    {ordered(K)},
    f AS (
      SELECT k, id, t, rn, false AS hit, t + {ttl}000000 AS dies FROM r WHERE rn = 1
      UNION ALL
      SELECT r.k, r.id, r.t, r.rn, r.t <= f.dies, CASE WHEN r.t <= f.dies THEN f.dies ELSE r.t + {ttl}000000 END
      FROM f JOIN r ON r.k = f.k AND r.rn = f.rn + 1)
    """


def keyed(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", F.get_json_object("props", "$.k").alias("k"))


C5 = f"WITH RECURSIVE {replay_sql(TTL)} SELECT k, id AS event_id, t AS ts_us, hit FROM f"


@query("c5_replay_cache", C5)
def _(spark, sf):
    return A.replay_cache(keyed(spark, sf), "k", "ts", "event_id", TTL).select("k", "event_id", "ts_us", "hit")


@query(
    "a8_cache_stats",
    f"WITH RECURSIVE {replay_sql(3600)} SELECT k, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, "
    "count(*) AS requests, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 6) AS hit_rate FROM f GROUP BY k",
)
def _(spark, sf):
    stats = cache_stats(A.replay_cache(keyed(spark, sf), "k", "ts", "event_id", 3600), ["k"])
    return stats.withColumn("hit_rate", r6("hit_rate"))


# --- streaming: run over everything that is there now ----------------------------


def event_stream(spark, sf):
    return read_stream(spark, f"{sf}/events.parquet")


def events_in_parts(spark, sf):
    """The events as three files in the order of time, a micro-batch each, so that limiters carry their state over."""
    path = scratch_dir(spark, "parts")
    e = table(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    span = e.agg(F.min(t).alias("first"), F.max(t).alias("last")).first()
    width = ((span["last"] or 0) - (span["first"] or 0)) // 3 + 1
    for n in range(3):
        e.where(F.floor((t - (span["first"] or 0)) / width) == n).coalesce(1).write.mode("append").parquet(path)
    return read_stream(spark, path, max_files=1)


@query("t2_stream_token_bucket", W5.replace("AS retry_after FROM f", "AS retry_after, false AS late FROM f"))
def _(spark, sf):
    out = run_to_table(SA.stream_token_bucket(events_in_parts(spark, sf), "event_type", "ts", "event_id", 3, 0.0005), "t2")
    return out.withColumn("retry_after", r6("retry_after"))


@query("t3_stream_sliding_admit", W4.replace("AS retry_after FROM f", "AS retry_after, false AS late FROM f"))
def _(spark, sf):
    return run_to_table(
        SA.stream_sliding_admit(events_in_parts(spark, sf), "event_type", "ts", "event_id", 9, 6 * 3600), "t3"
    )


@query("t5_stream_dedupe_ttl", C5.replace("hit FROM f", "hit, false AS late FROM f"))
def _(spark, sf):
    stream = events_in_parts(spark, sf).withColumn("k", F.get_json_object("props", "$.k"))
    return run_to_table(SA.stream_dedupe_ttl(stream, "k", "ts", "event_id", TTL), "t5")


WINDOW = ["provider", "window_start"]


def usage_sql(seconds, slide):
    width, step = seconds * 1_000_000, slide * 1_000_000
    return (
        f"SELECT event_type AS provider, s AS start_us, count(*) AS n_requests FROM (SELECT event_type, "
        f"unnest(range(epoch_us(ts) // {step} * {step} - {width - step}, epoch_us(ts) + 1, {step})) AS s FROM events) "
        "GROUP BY ALL"
    )


@query("t4_stream_window_usage", usage_sql(21600, 21600))
def _(spark, sf):
    out = run_to_latest(SS.stream_window_usage(event_stream(spark, sf), "event_type", "ts", 21600), WINDOW, "t4")
    return out.select("provider", F.unix_micros("window_start").alias("start_us"), "n_requests")


@query("t4_stream_window_usage_sliding", usage_sql(21600, 3600))
def _(spark, sf):
    out = run_to_latest(SS.stream_window_usage(event_stream(spark, sf), "event_type", "ts", 21600, 3600), WINDOW, "t4")
    return out.select("provider", F.unix_micros("window_start").alias("start_us"), "n_requests")


@query(
    "t6_stream_summary",
    "SELECT event_type, count(*) AS requests_total, count(*) FILTER (value <= 40) AS requests_successful, "
    "count(*) FILTER (value > 40) AS requests_failed, round(avg(value), 6) AS average_response_time, "
    "round(avg(CASE WHEN user_id < 20 THEN 1.0 ELSE 0.0 END), 6) AS cache_hit_rate FROM events GROUP BY event_type",
)
def _(spark, sf):
    m = SS.stream_summary(
        event_stream(spark, sf), F.col("value") > 40, F.col("value"), F.col("user_id") < 20, ["event_type"]
    )
    return run_to_latest(m, ["event_type"], "t6").withColumns({c: r6(c) for c in ("average_response_time", "cache_hit_rate")})


# Four micro-batches of a stream: its files come in the order of ``part``. Some texts are missing or blank.
SQL_INTAKE = (
    "(SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN NULL WHEN doc_id % 13 = 5 THEN '  ' ELSE text END AS text, "
    "(doc_id // 7) % 4 AS part FROM documents)"
)
SQL_REWRITES = (
    f"(SELECT i.doc_id, i.text AS original, 'Processed: ' || i.text AS paraphrase, first_part < part AS cached FROM {SQL_INTAKE} i "
    f"JOIN (SELECT text, min(part) AS first_part FROM {SQL_INTAKE} WHERE trim(text) <> '' GROUP BY text) USING (text))"
)


def intake(spark, sf):
    """The documents in four parts that arrive one after the other: a folder and, for each part, what puts its files there."""
    path = scratch_dir(spark, "intake")
    d = table(spark, sf, "documents")
    body = F.when(F.col("doc_id") % 11 == 3, F.lit(None)).when(F.col("doc_id") % 13 == 5, F.lit("  ")).otherwise(F.col("text"))
    rows = d.select("doc_id", body.alias("text"), (F.floor(F.col("doc_id") / 7) % 4).alias("part"))
    return path, [lambda n=n: rows.where(F.col("part") == n).drop("part").write.mode("append").parquet(path) for n in range(4)]


@query(
    "t1_stream_rewrite_and_score",
    f"WITH {sql_scores(SQL_REWRITES, 'doc_id')} SELECT doc_id, paraphrase AS result, "
    + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
    + ", CAST(NULL AS VARCHAR) AS violation, cached FROM scored UNION ALL SELECT doc_id, NULL, "
    + ", ".join("0" for _ in METRICS)
    + f", CASE WHEN text IS NULL THEN '{C.NOT_A_STRING}' ELSE '{C.EMPTY_TEXT}' END, false FROM {SQL_INTAKE} WHERE text IS NULL OR trim(text) = ''",
)
def _(spark, sf):
    path = scratch_dir(spark, "t1")
    folder, parts = intake(spark, sf)
    now = lambda: F.lit("2024-01-20 00:00:00").cast("timestamp")
    kept = ResultsStore(spark, f"{path}/memo")
    cores = spark.sparkContext.defaultParallelism
    for arrives in parts:
        # all files that came since the last run are one micro-batch, read by as many tasks as they are large
        arrives()
        texts = read_stream(spark, folder)
        SS.start_rewrite_and_score(texts, kept, path, now, parallel=cores).awaitTermination()
    return SS.scored_rows(texts, path).select("doc_id", "result", *[r6(m).alias(m) for m in METRICS], "violation", "cached")

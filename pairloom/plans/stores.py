"""Registered queries: results store, memoised calls, model functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.operators import generate as G
from pairloom.operators import store as S
from pairloom.operators.lookup import hot_keys
from pairloom.operators.providers import with_limits
from pairloom.operators.summaries import store_stats
from pairloom.plans.common import query, quoted, table
from pairloom.plans.texts import SETTINGS, SQL_PROVIDER, routed
from pairloom.session import scratch_dir

NOW_SQL = "TIMESTAMP '2024-01-20 00:00:00'"
# A key is the request's k and user; some requests ask for keys that were never stored.
K = "(json_extract_string(props, '$.k') || ':' || user_id)"
ASKED = f"({K} || CASE WHEN value > 48 THEN ':new' ELSE '' END)"


def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def key():
    return F.concat_ws(":", F.get_json_object("props", "$.k"), F.col("user_id").cast("string"))


def asked_key():
    return F.concat(key(), F.when(F.col("value") > 48, F.lit(":new")).otherwise(F.lit("")))


FIRST_TIER = "event_id % 2 = 0"
SECOND_TIER = "event_id % 2 = 1"


def entries(spark, sf, which="true"):
    """An entry for every request, or for those written to one of two stores; expires after a week, or never."""
    e = table(spark, sf, "events").where(which)
    ts = F.col("ts").cast("timestamp")
    dies = F.when(F.col("value") <= 20, ts + F.expr("INTERVAL 7 DAYS"))
    return e.select(
        key().alias("key"), F.col("event_id").cast("string").alias("value"),
        ts.alias("created_at"), dies.alias("expires_at"),
    )


def sql_entries(which="true"):
    return (
        f"(SELECT {K} AS key, CAST(event_id AS VARCHAR) AS value, ts AS created_at, "
        f"CASE WHEN value <= 20 THEN ts + INTERVAL 7 DAYS END AS expires_at FROM events WHERE {which})"
    )


def sql_store(which="true"):
    return (
        f"(SELECT key, value, created_at, expires_at FROM {sql_entries(which)} "
        "QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, value DESC) = 1)"
    )


def store(spark, sf, which="true"):
    return S.store_upsert(spark.createDataFrame([], S.ENTRY_SCHEMA), entries(spark, sf, which))


def requests(spark, sf):
    return table(spark, sf, "events").select("event_id", asked_key().alias("key"))


LIVE = f"(expires_at IS NULL OR {NOW_SQL} <= expires_at)"


def shown(df):
    return df.select(
        "key", "value", F.unix_micros("created_at").alias("created_us"), F.unix_micros("expires_at").alias("expires_us")
    )


SHOWN = "key, value, epoch_us(created_at) AS created_us, epoch_us(expires_at) AS expires_us"


@query(
    "k3_results_store_upsert",
    f"SELECT {SHOWN} FROM (SELECT *, 0 AS v FROM {sql_store(FIRST_TIER)} UNION ALL SELECT *, 1 AS v FROM {sql_store(SECOND_TIER)}) "
    "QUALIFY row_number() OVER (PARTITION BY key ORDER BY v DESC) = 1",
)
def _(spark, sf):
    kept = S.ResultsStore(spark, scratch_dir(spark, "store"))
    kept.put(entries(spark, sf, FIRST_TIER))
    kept.put(entries(spark, sf, SECOND_TIER))
    return shown(kept.read())


@query(
    "j2_cache_lookup",
    f"WITH r AS (SELECT event_id, {ASKED} AS key FROM events) SELECT event_id, r.key, s.value, s.key IS NOT NULL AS hit FROM r LEFT JOIN "
    f"(SELECT * FROM {sql_store()} WHERE {LIVE}) s ON s.key = r.key",
)
def _(spark, sf):
    asked = requests(spark, sf)
    return S.cache_lookup(asked, store(spark, sf), now(), hot_keys(asked, "key")).select(
        "event_id", "key", "value", "hit"
    )


@query(
    "j3_cache_exists",
    f"SELECT event_id, {ASKED} AS key FROM events WHERE {ASKED} IN (SELECT key FROM {sql_store()} WHERE {LIVE})",
)
def _(spark, sf):
    return S.cache_exists(requests(spark, sf), store(spark, sf), now()).select("event_id", "key")


@query(
    "j4_cache_misses",
    f"SELECT event_id, {ASKED} AS key FROM events WHERE {ASKED} NOT IN (SELECT key FROM {sql_store()} WHERE {LIVE})",
)
def _(spark, sf):
    return S.cache_misses(requests(spark, sf), store(spark, sf), now()).select("event_id", "key")


SQL_TIERS = (
    f"p AS (SELECT * FROM {sql_store(FIRST_TIER)} WHERE {LIVE}), s AS (SELECT * FROM {sql_store(SECOND_TIER)} WHERE {LIVE}), "
    f"r AS (SELECT event_id, {ASKED} AS key FROM events)"
)


@query(
    "j5_two_tier_lookup",
    f"WITH {SQL_TIERS} SELECT event_id, key, coalesce(p.value, s.value) AS value, CASE WHEN p.key IS NOT NULL THEN 'primary' "
    "WHEN s.key IS NOT NULL THEN 'secondary' END AS tier FROM r LEFT JOIN p USING (key) LEFT JOIN s USING (key)",
)
def _(spark, sf):
    answers, _ = S.two_tier_lookup(requests(spark, sf), store(spark, sf, FIRST_TIER), store(spark, sf, SECOND_TIER), now())
    return answers.select("event_id", "key", "value", "tier")


@query(
    "j5_two_tier_promote",
    f"WITH {SQL_TIERS} SELECT key, value, epoch_us({NOW_SQL}) AS created_us, CAST(NULL AS BIGINT) AS expires_us FROM s "
    "WHERE key IN (SELECT key FROM r) AND key NOT IN (SELECT key FROM p)",
)
def _(spark, sf):
    _, promoted = S.two_tier_lookup(requests(spark, sf), store(spark, sf, FIRST_TIER), store(spark, sf, SECOND_TIER), now())
    return shown(promoted)


@query(
    "j6_provider_limits",
    "SELECT event_id, provider, capacity, refill FROM (SELECT event_id, lower(coalesce(nullif(p, ''), 'openrouter')) AS provider "
    f"FROM (SELECT event_id, {SQL_PROVIDER} AS p FROM events)) LEFT JOIN (VALUES ('openrouter', 30.0::DOUBLE, 0.5::DOUBLE), "
    "('gemini', 60.0::DOUBLE, 1.0::DOUBLE)) l(provider, capacity, refill) USING (provider)",
)
def _(spark, sf):
    from pairloom.functions.requests import canonical_provider

    e = routed(table(spark, sf, "events")).select("event_id", canonical_provider(F.col("provider")).alias("provider"))
    return with_limits(e).select("event_id", "provider", "capacity", "refill")


@query(
    "j7_cache_delete",
    f"SELECT {SHOWN} FROM {sql_store()} WHERE key NOT IN (SELECT {K} FROM events WHERE value > 45)",
)
def _(spark, sf):
    gone = table(spark, sf, "events").where("value > 45").select(key().alias("key"))
    return shown(S.cache_delete(store(spark, sf), gone))


@query(
    "c1_memoized_transform",
    f"SELECT doc_id, '{C.OFFLINE_REPLY_PREFIX}' || text AS result, text IN (SELECT text FROM documents WHERE lang IN ('en', 'fr')) "
    "AS cached FROM documents",
)
def _(spark, sf):
    kept = S.ResultsStore(spark, scratch_dir(spark, "memo"))
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    earlier = F.lit("2024-01-19 23:30:00").cast("timestamp")
    G.memoized_transform(d.where("lang IN ('en', 'fr')"), kept, earlier)
    return G.memoized_transform(d, kept, now()).select("doc_id", "result", "cached")


@query(
    "c2_store_get_after_delete",
    f"WITH kept AS (SELECT * FROM {sql_store()} WHERE key NOT IN (SELECT {K} FROM events WHERE value > 45)), "
    f"r AS (SELECT event_id, {ASKED} AS key FROM events) SELECT event_id, r.key, kept.value FROM r JOIN kept ON kept.key = r.key WHERE {LIVE}",
)
def _(spark, sf):
    kept = S.ResultsStore(spark, scratch_dir(spark, "store"))
    kept.put(entries(spark, sf))
    kept.delete(table(spark, sf, "events").where("value > 45").select(key().alias("key")))
    found = S.cache_lookup(requests(spark, sf), kept.read(), now())
    return found.where("hit").select("event_id", "key", "value")


@query(
    "c3_store_clear",
    f"SELECT (SELECT count(*) FROM {sql_store()}) AS n_before, CAST(0 AS BIGINT) AS n_after",
)
def _(spark, sf):
    kept = S.ResultsStore(spark, scratch_dir(spark, "store"))
    kept.put(entries(spark, sf))
    before = kept.read().select(F.lit("before").alias("at"))
    kept.clear()
    both = before.unionByName(kept.read().select(F.lit("after").alias("at")))
    return both.agg(
        F.count_if(F.col("at") == "before").alias("n_before"), F.count_if(F.col("at") == "after").alias("n_after")
    )


@query("c4_store_purge_expired", f"SELECT {SHOWN} FROM {sql_store()} WHERE {LIVE}")
def _(spark, sf):
    kept = S.ResultsStore(spark, scratch_dir(spark, "store"))
    kept.put(entries(spark, sf))
    kept.purge(now())
    return shown(kept.read())


SQL_WIDE = (
    "(SELECT CAST(event_id AS VARCHAR) AS key, event_type AS value, ts AS created_at, "
    "CASE WHEN value <= 20 THEN ts + INTERVAL 7 DAYS END AS expires_at FROM events)"
)


def wide_store(spark, sf):
    e = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("value"), ts.alias("created_at"),
        F.when(F.col("value") <= 20, ts + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
    )


@query(
    "w8_store_compact",
    f"WITH kept AS (SELECT *, row_number() OVER (ORDER BY created_at, key) AS rn, count(*) OVER () AS n FROM {SQL_WIDE} WHERE {LIVE}) "
    f"SELECT {SHOWN} FROM kept WHERE (SELECT count(*) FROM {SQL_WIDE}) >= 1000 AND (n < 1000 OR rn > n // 4) "
    f"UNION ALL SELECT {SHOWN} FROM {SQL_WIDE} WHERE (SELECT count(*) FROM {SQL_WIDE}) < 1000",
)
def _(spark, sf):
    return shown(S.store_compact(wide_store(spark, sf), now(), 1000))


@query(
    "a8_store_stats",
    f"SELECT count(*) FILTER ({LIVE}) AS live_entries, count(*) FILTER (NOT {LIVE}) AS expired_entries FROM {SQL_WIDE}",
)
def _(spark, sf):
    return store_stats(wide_store(spark, sf), now())


# --- model functions ------------------------------------------------------------


@query(
    "u1_generate",
    "SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE 'Processed: ' || text END AS result, "
    "CASE WHEN lang = 'de' THEN 'failed' ELSE 'ok' END AS status, CAST(CASE WHEN lang = 'de' THEN 3 ELSE 1 END AS BIGINT) AS attempts, "
    "CASE WHEN lang = 'de' THEN 'ValueError: no model for it' END AS error FROM documents",
)
def _(spark, sf):
    def model(text):
        if text.startswith("de:"):
            raise ValueError("no model for it")
        return C.OFFLINE_REPLY_PREFIX + text

    asked = F.when(F.col("lang") == "de", F.concat(F.lit("de:"), "text")).otherwise(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", asked.alias("text"))
    made = G.generate(d, model, max_retries=2, retry_delay=0)
    return made.select("doc_id", "result", "status", F.col("attempts").cast("bigint").alias("attempts"), "error")


@query(
    "u2_classify",
    f"SELECT doc_id, CASE WHEN length({quoted(C.CLASSIFY_PROMPT_HEAD)} || text || {quoted(C.CLASSIFY_PROMPT_TAIL)}) > 1000 THEN '1' "
    "WHEN lang = 'fr' THEN NULL ELSE '0' END AS label, quality FROM documents JOIN labels USING (doc_id)",
)
def _(spark, sf):
    def model(prompt):
        if len(prompt) > 1000:
            return "The answer is 1"
        return "0 or 1" if "fr:" in prompt[:300] else "0"

    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    # The marker keeps the length: it replaces the first three characters.
    marked = F.when(F.col("lang") == "fr", F.concat(F.lit("fr:"), F.expr("substring(text, 4)"))).otherwise(F.col("text"))
    d = d.select("doc_id", "quality", F.regexp_replace(marked, "^(?!fr:)...", "...").alias("text"))
    return G.classify(d, model).select("doc_id", "label", "quality")


@query(
    "u5_dispatch",
    "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'Unknown provider.' WHEN event_type = 'view' AND user_id < 10 THEN "
    "'Could not generate paraphrase.' WHEN event_type = 'view' THEN 'g/' || m || '/' || props WHEN user_id < 5 THEN 'Error generating paraphrase.' "
    "ELSE 'o/' || m || '/' || props END AS result FROM (SELECT *, CASE WHEN value > 40 THEN 'custom' WHEN event_type = 'view' THEN "
    "'env-model' ELSE 'file-model' END AS m FROM events)",
)
def _(spark, sf):
    def first(text, model):
        user, body = text.split("|", 1)
        if int(user) < 5:
            raise RuntimeError("refused")
        return f"o/{model}/{body}"

    def second(text, model):
        user, body = text.split("|", 1)
        return None if int(user) < 10 else f"g/{model}/{body}"

    e = routed(table(spark, sf, "events")).withColumn("text", F.concat_ws("|", F.col("user_id").cast("string"), "props"))
    settings = spark.createDataFrame(SETTINGS, "provider string, override string, file_value string")
    rows = e.select("event_id", "provider", "model", "text")
    return G.dispatch(rows, {"openrouter": first, "gemini": second}, settings=settings).select("event_id", "result")


SQL_MODEL = "CASE WHEN value > 40 THEN 'custom' WHEN event_type = 'view' THEN 'env-model' ELSE 'file-model' END"
# what the earlier run stored: replies, and not the fixed messages
SQL_STORED = "event_type = 'view' AND user_id >= 10"


@query(
    "c1_memoized_dispatch",
    f"SELECT event_id, {SQL_MODEL} AS model_name, CASE WHEN event_type = 'purchase' THEN 'Unknown provider.' "
    "WHEN event_type = 'view' AND user_id < 10 THEN 'Could not generate paraphrase.' "
    f"WHEN event_type = 'view' THEN 'g/' || {SQL_MODEL} || '/' || props WHEN user_id < 5 THEN 'Error generating paraphrase.' "
    f"ELSE 'o/' || {SQL_MODEL} || '/' || props END AS result, "
    f"CAST(CASE WHEN event_type = 'purchase' OR {SQL_STORED} THEN 0 WHEN event_type <> 'view' AND user_id < 5 THEN 2 ELSE 1 END AS BIGINT) AS attempts, "
    "CASE WHEN event_type NOT IN ('purchase', 'view') AND user_id < 5 THEN 'RuntimeError: refused' END AS error, "
    f"{SQL_STORED} AS cached FROM events",
)
def _(spark, sf):
    def first(texts, model):
        # one text like this fails the call of its whole list
        if any(int(t.split("|", 1)[0]) < 5 for t in texts):
            raise RuntimeError("refused")
        return [f"o/{model}/{t.split('|', 1)[1]}" for t in texts]

    def second(texts, model):
        pairs = [t.split("|", 1) for t in texts]
        return [None if int(user) < 10 else f"g/{model}/{body}" for user, body in pairs]

    e = routed(table(spark, sf, "events")).withColumn("text", F.concat_ws("|", F.col("user_id").cast("string"), "props"))
    settings = spark.createDataFrame(SETTINGS, "provider string, override string, file_value string")
    kept = S.ResultsStore(spark, scratch_dir(spark, "dispatch"))
    calls = {"settings": settings, "max_retries": 1, "retry_delay": 0}
    earlier = F.lit("2024-01-19 23:30:00").cast("timestamp")
    rows = e.select("event_id", "event_type", "provider", "model", "text")
    G.memoized_dispatch(rows.where("event_type = 'view'"), {"gemini": second}, kept, earlier, **calls)
    done = G.memoized_dispatch(rows, {"openrouter": first, "gemini": second}, kept, now(), **calls)
    return done.select("event_id", "model_name", "result", F.col("attempts").cast("bigint").alias("attempts"), "error", "cached")


@query(
    "u6_retry_pass",
    "SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE 'Processed: ' || text END AS result, "
    "CASE WHEN lang = 'de' THEN 'failed' ELSE 'ok' END AS status, CAST(CASE WHEN lang = 'de' THEN 4 ELSE 1 END AS BIGINT) AS attempts, "
    "CASE WHEN lang = 'de' THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS wait FROM documents",
)
def _(spark, sf):
    def model(text):
        if text.startswith("de:"):
            raise ValueError("no model for it")
        return C.OFFLINE_REPLY_PREFIX + text

    asked = F.concat(F.when(F.col("lang") == "de", F.lit("de:")).otherwise(F.lit("")), "text")
    d = table(spark, sf, "documents").select("doc_id", asked.alias("text"))
    done = G.retry_pass(d, model, "doc_id")
    return done.select("doc_id", "result", "status", F.col("attempts").cast("bigint").alias("attempts"), "wait")


@query(
    "u8_with_observation",
    "SELECT doc_id, true AS timed, CASE WHEN lang = 'de' THEN 'failed' ELSE 'ok' END AS status, (SELECT count(*) FROM documents) AS calls, "
    "(SELECT count(*) FROM documents WHERE lang = 'de') AS errors, true AS summed FROM documents",
)
def _(spark, sf):
    def model(text):
        if text.startswith("de:"):
            raise ValueError("no model for it")
        return C.OFFLINE_REPLY_PREFIX + text

    asked = F.concat(F.when(F.col("lang") == "de", F.lit("de:")).otherwise(F.lit("")), "text")
    d = table(spark, sf, "documents").select("doc_id", asked.alias("text"))
    made, seen = G.with_observation(d, model, max_retries=0)
    path = scratch_dir(spark, "observed")
    made.select("doc_id", "seconds", "status").write.parquet(path)
    totals = seen.get  # there since the rows were written
    rows = spark.read.parquet(path)
    written = rows.agg(F.sum("seconds").alias("sum"), F.max("seconds").alias("most")).first()
    agree = abs(written["sum"] - totals["seconds"]) < 1e-6 and written["most"] == totals["slowest"]
    return rows.select(
        "doc_id", (F.col("seconds") >= 0).alias("timed"), "status",
        F.lit(totals["calls"]).alias("calls"), F.lit(totals["errors"]).alias("errors"), F.lit(agree).alias("summed"),
    )

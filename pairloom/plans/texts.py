"""Registered queries: sources, sinks, validation, request columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions import requests as R
from pairloom.functions import text as T
from pairloom.operators import pairing, providers, summaries, validate
from pairloom.operators.ordered import ranked
from pairloom.operators.store import ResultsStore
from pairloom.plans import jobs
from pairloom.plans.common import PAIRS, big, conversation_pairs, query, quoted, r6, sql_strip, table
from pairloom.session import scratch_dir, text_parts
from pairloom.sources import readers, writers
from pairloom.streaming.files import read_stream, run_to_table

FLAT = r"regexp_replace({}, '\s+', ' ', 'g')"


def write_tsv(df, path):
    df.write.csv(
        path, sep="\t", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def flat(name):
    return F.regexp_replace(name, r"[\t\n\f\r ]+", " ")


@query(
    "s1_read_pairs_tsv",
    f"SELECT {FLAT.format('original')} AS text1, {FLAT.format('paraphrase')} AS text2 FROM {PAIRS}",
)
def _(spark, sf):
    path = scratch_dir(spark, "tsv")
    pairs = conversation_pairs(spark, sf)
    write_tsv(pairs.select(flat("original"), flat("paraphrase")), path)
    return readers.read_pairs_tsv(spark, path)


@query(
    "s2_read_splits",
    f"SELECT 'train' AS split, {FLAT.format('original')} AS text1, {FLAT.format('paraphrase')} AS text2 FROM {PAIRS} "
    f"UNION ALL SELECT 'eval', source, {FLAT.format('text')} FROM documents",
)
def _(spark, sf):
    base = scratch_dir(spark, "tsv")
    write_tsv(conversation_pairs(spark, sf).select(flat("original"), flat("paraphrase")), base + "/train")
    write_tsv(table(spark, sf, "documents").select("source", flat("text")), base + "/eval")
    return readers.read_splits(spark, base + "/train", base + "/eval")


@query(
    "s3_read_text_lines",
    f"SELECT line, count(*) AS n FROM (SELECT {sql_strip('l')} AS line FROM "
    r"(SELECT unnest(string_split_regex(text, '\r\n|\n|\r')) AS l FROM documents)) WHERE line <> '' GROUP BY line",
)
def _(spark, sf):
    path = scratch_dir(spark, "lines")
    table(spark, sf, "documents").select("text").write.text(path)
    return readers.read_text_lines(spark, path).groupBy(F.col("text").alias("line")).agg(F.count("*").alias("n"))


@query(
    "s4_texts_from_list",
    "SELECT doc_id AS batch_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos, unnest(parts) AS text "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("parts"))
    return readers.texts_from_arrays(d, "doc_id", "parts")


def log_lines(events):
    failed = F.col("event_type") == "error"
    record = F.to_json(F.struct(
        F.when(failed, "Function failed").otherwise("Function completed").alias("event"),
        F.lit("performance").alias("logger"),
        F.when(failed, "error").otherwise("info").alias("level"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.concat(F.lit("handle_"), F.col("user_id").cast("string")).alias("function"),
        F.format_string("%.3fs", "value").alias("execution_time"),
        F.when(failed, F.get_json_object("props", "$.k")).alias("error"),
    ))
    prefix = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 - performance - INFO - "))
    return events.select(F.concat(prefix, record).alias("value"))


def request_log(spark, sf):
    path = scratch_dir(spark, "log")
    log_lines(table(spark, sf, "events")).write.text(path)
    return readers.read_request_log(spark, path)


@query(
    "s5_read_request_log",
    "SELECT CASE WHEN event_type = 'error' THEN 'Function failed' ELSE 'Function completed' END AS event, "
    "'performance' AS logger, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, "
    "epoch_us(ts) AS ts_us, 'handle_' || user_id AS function, round(value, 3) AS seconds, "
    "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS outcome, "
    "CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') END AS error FROM events",
)
def _(spark, sf):
    log = request_log(spark, sf)
    return log.select("event", "logger", "level", F.unix_micros("ts").alias("ts_us"), "function", "seconds", "outcome", "error")


# A result column with failures (NULL, empty), from the language of the text.
SQL_RESULT = "CASE lang WHEN 'fr' THEN NULL WHEN 'de' THEN '' ELSE 'Processed: ' || text END"


def with_result(d):
    return d.withColumn(
        "result",
        F.when(F.col("lang") == "fr", F.lit(None)).when(F.col("lang") == "de", F.lit("")).otherwise(
            F.concat(F.lit(C.OFFLINE_REPLY_PREFIX), F.col("text"))
        ),
    )


SQL_BLOCK = f"'Original: ' || text || chr(10) || 'Paraphrase: ' || coalesce(nullif({SQL_RESULT}, ''), 'FAILED') || chr(10) || repeat('-', 40)"


@query("k1_write_report_text", f"SELECT doc_id, {SQL_BLOCK} AS block FROM documents")
def _(spark, sf):
    return writers.report_rows(with_result(table(spark, sf, "documents"))).select("doc_id", "block")


@query("k1_report_order", f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, {SQL_BLOCK} AS block FROM documents")
def _(spark, sf):
    """Blocks of the written report in the order of its files."""
    path = scratch_dir(spark, "report")
    writers.write_report_text(with_result(table(spark, sf, "documents")), path, order=("doc_id",))
    rule = "-" * 40
    whole = spark.read.option("lineSep", f"\n{rule}\n").text(path).select(
        F.col("value"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"),
    )
    numbered = ranked(whole, [], ["file", "start", "at"], "place")
    return numbered.select((F.col("place") - 1).alias("place"), F.concat("value", F.lit(f"\n{rule}")).alias("block"))


@query(
    "k2_write_results",
    f"SELECT doc_id, text AS original, {SQL_RESULT} AS paraphrase, ({SQL_RESULT}) IS NOT NULL AS success FROM documents",
)
def _(spark, sf):
    path = scratch_dir(spark, "results")
    writers.write_results(with_result(table(spark, sf, "documents")), path, keep=["doc_id"])
    return spark.read.parquet(path)


@query("k4_stream_sink", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf):
    # files of a bounded size, a quarter of them in each micro-batch
    path = scratch_dir(spark, "sink-in")
    d = table(spark, sf, "documents")
    d.repartition(text_parts(d, "text"), "doc_id").write.parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return run_to_table(read_stream(spark, path, max_files=-(-files // 4)), "sink").select("doc_id", "text", "lang", "source", "n_chars")


# --- validation ---------------------------------------------------------------

SQL_MIXED = "CASE lang WHEN 'es' THEN NULL WHEN 'de' THEN '  ' || chr(9) ELSE text END"


def mixed(d):
    """Documents with missing, blank and untrimmed texts among them."""
    col = F.when(F.col("lang") == "es", F.lit(None)).when(F.col("lang") == "de", F.lit("  \t"))
    return d.withColumn("text", col.otherwise(F.col("text")))


@query(
    "v1_validate_texts",
    f"SELECT doc_id, CASE WHEN t IS NULL THEN '{C.NOT_A_STRING}' WHEN {sql_strip('t')} = '' THEN '{C.EMPTY_TEXT}' "
    f"WHEN length(t) > 10000 THEN '{C.TEXT_TOO_LONG}' END AS violation "
    f"FROM (SELECT doc_id, {SQL_MIXED} AS t FROM documents)",
)
def _(spark, sf):
    return validate.validate_texts(mixed(table(spark, sf, "documents"))).select("doc_id", "violation")


@query(
    "v2_validate_batch_size",
    "SELECT batch_id, coalesce(n, 0) AS n_texts, CASE WHEN coalesce(n, 0) = 0 THEN 'Input list cannot be empty' "
    "WHEN n > 500 THEN 'Too many texts (max 500)' END AS violation "
    "FROM (SELECT DISTINCT lang AS batch_id FROM documents UNION SELECT n_name FROM nation) "
    "LEFT JOIN (SELECT lang AS batch_id, count(*) AS n FROM documents GROUP BY lang) USING (batch_id)",
)
def _(spark, sf):
    items = table(spark, sf, "documents").select(F.col("lang").alias("batch_id"))
    batches = items.unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("batch_id")))
    return validate.validate_batch_size(items, limit=500, batches=batches)


@query(
    "v3_validate_request",
    f"SELECT doc_id, {sql_strip('t')} AS text, CASE WHEN t IS NULL THEN '{C.NOT_A_STRING}' "
    f"WHEN length(t) > 10000 THEN '{C.TEXT_TOO_LONG}' WHEN {sql_strip('t')} = '' THEN '{C.EMPTY_TEXT}' END AS violation "
    f"FROM (SELECT doc_id, ' ' || ({SQL_MIXED}) || chr(160) AS t FROM documents)",
)
def _(spark, sf):
    padded = mixed(table(spark, sf, "documents")).withColumn("text", F.concat(F.lit(" "), "text", F.lit("\xa0")))
    return validate.validate_request(padded).select("doc_id", "text", "violation")


@query(
    "v4_validate_eval_pairs",
    "SELECT conv_id, turn, CASE WHEN o.text IS NULL OR p.text IS NULL THEN 'length mismatch' END AS violation "
    "FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user') o FULL OUTER JOIN "
    "(SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') p USING (conv_id, turn)",
)
def _(spark, sf):
    c = table(spark, sf, "conversations")
    o = c.where("role = 'user'").select("conv_id", "turn", "text")
    p = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return validate.validate_eval_pairs(o, p, ("conv_id", "turn")).select("conv_id", "turn", "violation")


@query("v5_preview", "SELECT doc_id, left(text, 100) AS head, left(text, 80) AS sample FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.preview(F.col("text")).alias("head"), T.preview(F.col("text"), 80).alias("sample"))


@query(
    "v6_build_prompt",
    f"SELECT doc_id, {quoted(C.REWRITE_PROMPT)} || text AS rewrite, '{C.SEQ2SEQ_PREFIX}' || text AS seq2seq, "
    f"md5({quoted(C.CLASSIFY_PROMPT_HEAD)} || text || {quoted(C.CLASSIFY_PROMPT_TAIL)}) AS classify_md5 FROM documents",
)
def _(spark, sf):
    x = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", R.build_prompt(x).alias("rewrite"), R.build_prompt(x, "seq2seq").alias("seq2seq"),
        F.md5(R.build_prompt(x, "classify")).alias("classify_md5"),
    )


@query(
    "v7_build_chat_payload",
    f"SELECT doc_id, lang AS model, 'user' AS role, '{C.REWRITE_PROMPT}' || text AS content, '0.0' AS temperature, "
    "CAST(1 AS BIGINT) AS n_messages FROM documents",
)
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn(
        "payload", R.build_chat_payload(F.col("lang"), R.build_prompt(F.col("text")))
    )
    part = lambda p: F.get_json_object("payload", p)
    return d.select(
        "doc_id", part("$.model").alias("model"), part("$.messages[0].role").alias("role"),
        part("$.messages[0].content").alias("content"), part("$.temperature").alias("temperature"),
        big(F.json_array_length(part("$.messages"))).alias("n_messages"),
    )


@query(
    "v8_extract_chat_content",
    f"SELECT doc_id, CASE WHEN lang = 'es' OR lang = 'de' THEN NULL WHEN quality = 0 THEN NULL "
    f"WHEN toxic = 1 THEN NULL ELSE {sql_strip('text')} END AS content "
    "FROM documents LEFT JOIN labels USING (doc_id)",
)
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    said = F.struct(F.when(F.col("toxic") == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "text")).alias("content"))
    reply = F.to_json(F.struct(F.array(F.struct(said.alias("message"))).alias("choices")))
    body = F.when(F.col("lang") == "es", F.lit('{"choices": []}')).when(
        F.col("lang") == "de", F.lit('{"choices": [{"mess')
    ).otherwise(reply)
    status = F.when(F.col("quality") == 0, F.lit(403)).otherwise(F.lit(200))
    return d.select("doc_id", R.extract_chat_content(status, body).alias("content"))


@query(
    "v9_extract_candidate_text",
    "SELECT doc_id, CASE lang WHEN 'es' THEN source WHEN 'de' THEN '' ELSE text END AS content FROM documents",
)
def _(spark, sf):
    parts = F.array(F.struct(F.lit("").alias("text")), F.struct("text"), F.struct(F.lit("later").alias("text")))
    full = F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates"))
    body = F.when(F.col("lang") == "es", F.to_json(F.struct(F.col("source").alias("text")))).when(
        F.col("lang") == "de", F.lit('{"candidates": []}')
    ).otherwise(F.to_json(full))
    return table(spark, sf, "documents").select("doc_id", R.extract_candidate_text(body).alias("content"))


@query(
    "v10_normalize_label",
    "SELECT event_id, CASE WHEN contains(props, '0') AND NOT contains(props, '1') THEN '0' "
    "WHEN contains(props, '1') AND NOT contains(props, '0') THEN '1' END AS label FROM events",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", R.normalize_label(F.col("props")).alias("label"))


SQL_REPLY = (
    f"CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '{C.NO_RESULT}' WHEN 'signup' THEN '{C.UNKNOWN_PROVIDER}' "
    "ELSE props END"
)


def replies(e):
    kind = F.col("event_type")
    return e.withColumn(
        "reply",
        F.when(kind == "error", F.lit(None)).when(kind == "view", F.lit(C.NO_RESULT))
        .when(kind == "signup", F.lit(C.UNKNOWN_PROVIDER)).otherwise(F.col("props")),
    )


@query(
    "v11_result_status",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('view', 'signup') THEN 'fallback' "
    "ELSE 'ok' END AS status FROM events",
)
def _(spark, sf):
    return replies(table(spark, sf, "events")).select("event_id", R.result_status(F.col("reply")).alias("status"))


SQL_PROVIDER = (
    "CASE event_type WHEN 'click' THEN 'openrouter' WHEN 'view' THEN 'Gemini' WHEN 'error' THEN NULL "
    "WHEN 'purchase' THEN 'other' ELSE '' END"
)


def routed(e):
    kind = F.col("event_type")
    provider = (
        F.when(kind == "click", F.lit("openrouter")).when(kind == "view", F.lit("Gemini"))
        .when(kind == "error", F.lit(None)).when(kind == "purchase", F.lit("other")).otherwise(F.lit(""))
    )
    model = F.when(F.col("value") > 40, F.lit(" custom ")).when(F.col("value") > 20, F.lit("  "))
    return e.withColumn("provider", provider).withColumn("model", model)


SETTINGS = [("openrouter", None, "file-model\n"), ("gemini", "env-model", "file-model")]


@query(
    "v12_resolve_model",
    "SELECT event_id, CASE WHEN value > 40 THEN 'custom' WHEN event_type = 'view' THEN 'env-model' "
    "ELSE 'file-model' END AS model_name FROM events",
)
def _(spark, sf):
    settings = spark.createDataFrame(SETTINGS, "provider string, override string, file_value string")
    return providers.resolve_model(routed(table(spark, sf, "events")), settings=settings).select("event_id", "model_name")


@query(
    "v13_provider_features",
    "SELECT provider, feature, is_default, count(*) AS n_requests FROM (VALUES ('openrouter', 'paraphrase', true), "
    "('openrouter', 'classification', true), ('gemini', 'paraphrase', false)) f(provider, feature, is_default) "
    f"JOIN (SELECT lower(coalesce(nullif({SQL_PROVIDER}, ''), 'openrouter')) AS provider FROM events) USING (provider) "
    "GROUP BY ALL",
)
def _(spark, sf):
    asked = routed(table(spark, sf, "events")).select(R.canonical_provider(F.col("provider")).alias("provider"))
    return asked.join(providers.provider_features(spark), "provider").groupBy("provider", "feature", "is_default").agg(
        F.count("*").alias("n_requests")
    )


SQL_STATUS = "CASE event_type WHEN 'click' THEN 401 WHEN 'view' THEN 429 WHEN 'signup' THEN 500 END"


@query(
    "v14_classify_error",
    f"SELECT event_id, CASE event_type WHEN 'click' THEN 'AUTH_ERROR_' WHEN 'view' THEN 'RATE_LIMIT_' ELSE 'API_ERROR_' END "
    "|| 'P' || user_id AS error_code, CASE event_type WHEN 'click' THEN 'Authentication failed for provider: p' || user_id "
    "WHEN 'view' THEN 'Rate limit exceeded for provider: p' || user_id WHEN 'signup' THEN props "
    "WHEN 'error' THEN 'Connection error' ELSE 'Request timeout' END AS message, 'p' || user_id AS provider, "
    "CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) END AS retry_after, "
    "CASE WHEN event_type = 'signup' THEN '500' END AS status_code, props AS original_error FROM events",
)
def _(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "click", F.lit(401)).when(kind == "view", F.lit(429)).when(kind == "signup", F.lit(500))
    cause = F.when(kind == "error", F.lit("connection")).otherwise(F.lit("timeout"))
    provider = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    e = R.classify_error(status, cause, F.col("props"), provider, F.col("user_id"))
    return table(spark, sf, "events").select("event_id", e.alias("e")).select(
        "event_id", "e.error_code", "e.message", F.col("e.details")["provider"].alias("provider"),
        F.col("e.details")["retry_after"].alias("retry_after"), F.col("e.details")["status_code"].alias("status_code"),
        "e.original_error",
    )


@query(
    "v15_http_outcome",
    "SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 400 WHEN 'view' THEN 404 WHEN 'signup' THEN 502 "
    "WHEN 'purchase' THEN 200 ELSE 500 END AS BIGINT) AS http_status FROM events",
)
def _(spark, sf):
    kind = F.col("event_type")
    cls = (
        F.when(kind == "click", F.lit("validation")).when(kind == "view", F.lit("not_found"))
        .when(kind == "signup", F.lit("api")).when(kind == "error", F.lit("crash"))
    )
    return table(spark, sf, "events").select("event_id", big(R.http_outcome(cls)).alias("http_status"))


# --- pairing, order, outcome ----------------------------------------------------


@query(
    "j1_pair_by_position",
    "SELECT o.source AS batch_id, o.doc_id AS pos, o.text AS original, md5(p.text) AS paraphrase_md5 "
    "FROM documents o JOIN documents p ON p.source = o.source AND p.doc_id = o.doc_id",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("batch_id"), F.col("doc_id").alias("pos"), "text")
    rewritten = d.withColumn("text", F.md5("text"))
    return pairing.pair_by_position(d, rewritten).withColumnRenamed("paraphrase", "paraphrase_md5")


@query("w1_restore_order", "SELECT lang AS batch_id, doc_id AS pos, n_chars FROM documents ORDER BY 1, 2")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return pairing.restore_order(d.select(F.col("lang").alias("batch_id"), F.col("doc_id").alias("pos"), "n_chars"))


@query(
    "w2_chunk",
    "SELECT lang AS batch_id, doc_id AS pos, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 5 AS chunk_no "
    "FROM documents",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("batch_id"), F.col("doc_id").alias("pos"))
    return pairing.chunk(d, 5)


@query(
    "a2_batch_outcome",
    "SELECT user_id AS batch_id, count(*) AS total, count(reply) AS successful, "
    f"count(*) FILTER (reply IN ('{C.NO_RESULT}', '{C.UNKNOWN_PROVIDER}')) AS fallback, count(*) - count(reply) AS failed, "
    f"round(CAST(count(reply) AS DOUBLE) / count(*), 6) AS success_rate FROM (SELECT user_id, {SQL_REPLY} AS reply FROM events) "
    "GROUP BY user_id",
)
def _(spark, sf):
    e = replies(table(spark, sf, "events")).withColumnRenamed("user_id", "batch_id")
    return summaries.batch_outcome(e, result="reply").withColumn("success_rate", r6("success_rate"))


# Jobs: the turns of a conversation; a job without an assistant turn is pending.
JOB_EPOCH = 1_704_067_200


SQL_ITEMS = "(SELECT conv_id AS job_id, turn AS pos, CASE WHEN role = 'assistant' THEN md5(text) END AS result FROM conversations)"


def job_tables(spark, sf):
    """(jobs, items, errors): a conversation is a job, its turns are the items, its system turns errors."""
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "job_id")
    items = c.select("job_id", F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", F.md5("text")).alias("result"))
    answered = F.count("result") > 0
    jobs = items.groupBy("job_id").agg(
        F.when(answered, F.lit("completed")).otherwise(F.lit("pending")).alias("status"),
        F.timestamp_seconds(F.lit(JOB_EPOCH)).alias("created_at"),
        F.when(answered, F.timestamp_seconds(JOB_EPOCH + F.max("pos"))).alias("completed_at"),
    )
    errors = c.where("role = 'system'").select("job_id", F.col("text").alias("error"), F.col("turn").alias("at"))
    return jobs, items, errors


STATUS = ("job_id", "status", "total_items", "successful", "failed_items", "job_errors")


@query(
    "a3_job_status",
    f"""
    WITH c AS (SELECT job_id, count(*) AS total_items, count(result) AS successful, max(pos) AS last FROM {SQL_ITEMS} GROUP BY job_id),
    f AS (SELECT conv_id AS job_id, count(*) AS job_errors FROM conversations WHERE role = 'system' GROUP BY conv_id)
    SELECT job_id, CASE WHEN successful = 0 THEN 'pending' ELSE 'completed' END AS status, total_items, successful,
      total_items - successful AS failed_items, coalesce(job_errors, 0) AS job_errors,
      round(CAST(successful AS DOUBLE) / total_items, 6) AS success_rate,
      CASE WHEN successful > 0 THEN CAST(last AS DOUBLE) END AS processing_time
    FROM c LEFT JOIN f USING (job_id)
    """,
)
def _(spark, sf):
    done = summaries.job_status(*job_tables(spark, sf))
    return done.select(*STATUS, r6("success_rate").alias("success_rate"), "processing_time")


@query(
    "a3_job_results",
    f"SELECT job_id, pos, result FROM {SQL_ITEMS} WHERE job_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)",
)
def _(spark, sf):
    jobs, items, _ = job_tables(spark, sf)
    return summaries.job_results(jobs, items)


@query("a3_job_errors", "SELECT conv_id AS job_id, turn AS at, text AS error FROM conversations WHERE role = 'system'")
def _(spark, sf):
    jobs, _, errors = job_tables(spark, sf)
    return summaries.job_errors(jobs, errors)


SQL_LARGE = "(SELECT event_type AS job_id, event_id AS pos, CASE WHEN value > 5 THEN props END AS result FROM events)"


def large_jobs(spark, sf):
    """Few jobs with very many items and errors: a job per event type."""
    e = table(spark, sf, "events").withColumnRenamed("event_type", "job_id")
    items = e.select("job_id", F.col("event_id").alias("pos"), F.when(F.col("value") > 5, F.col("props")).alias("result"))
    jobs = e.select("job_id", F.lit("completed").alias("status"), F.timestamp_seconds(F.lit(JOB_EPOCH)).alias("created_at"),
                    F.timestamp_seconds(F.lit(JOB_EPOCH + 60)).alias("completed_at")).distinct()
    return jobs, items, e.where("value <= 5").select("job_id", F.col("props").alias("error"), F.col("event_id").alias("at"))


@query(
    "a3_large_job_status",
    f"SELECT job_id, 'completed' AS status, count(*) AS total_items, count(result) AS successful, count(*) - count(result) AS failed_items, "
    f"count(*) FILTER (result IS NULL) AS job_errors, round(CAST(count(result) AS DOUBLE) / count(*), 6) AS success_rate, "
    f"60.0::DOUBLE AS processing_time FROM {SQL_LARGE} GROUP BY job_id",
)
def _(spark, sf):
    done = summaries.job_status(*large_jobs(spark, sf))
    return done.select(*STATUS, r6("success_rate").alias("success_rate"), "processing_time")


@query("a3_large_job_results", f"SELECT job_id, pos, result FROM {SQL_LARGE}")
def _(spark, sf):
    jobs, items, _ = large_jobs(spark, sf)
    return summaries.job_results(jobs, items)


@query(
    "a4_split_sizes",
    f"SELECT 'train' AS split, count(*) AS n_rows FROM {PAIRS} UNION ALL SELECT 'eval', count(*) FROM documents",
)
def _(spark, sf):
    both = conversation_pairs(spark, sf).select(F.lit("train").alias("split")).unionByName(
        table(spark, sf, "documents").select(F.lit("eval").alias("split"))
    )
    return summaries.split_sizes(both)


@query(
    "a6_request_metrics",
    "SELECT count(*) AS requests_total, count(*) FILTER (event_type <> 'error') AS requests_successful, "
    "count(*) FILTER (event_type = 'error') AS requests_failed, round(avg(value), 6) AS average_response_time, "
    "round(avg(CASE WHEN user_id < 20 THEN 1.0 ELSE 0.0 END), 6) AS cache_hit_rate FROM events",
)
def _(spark, sf):
    m = summaries.request_metrics(
        table(spark, sf, "events"), F.col("event_type") == "error", F.col("value"), F.col("user_id") < 20
    )
    return m.withColumns({c: r6(c) for c in ("average_response_time", "cache_hit_rate")})


@query(
    "a7_function_latency",
    "SELECT 'handle_' || user_id AS function, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS outcome, "
    "count(*) AS n_calls, round(avg(round(value, 3)), 6) AS avg_seconds, round(max(value), 3) AS max_seconds, "
    "count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY ALL",
)
def _(spark, sf):
    return summaries.function_latency(request_log(spark, sf)).withColumn("avg_seconds", r6("avg_seconds"))


@query(
    "a9_rate_usage",
    "SELECT provider, epoch_us(w) AS window_us, n AS n_requests, capacity, round(n / capacity, 6) AS used_share, "
    "n > capacity AS over_limit FROM (SELECT event_type AS provider, time_bucket(INTERVAL 6 HOURS, ts) AS w, count(*) AS n "
    "FROM events GROUP BY ALL) LEFT JOIN (VALUES ('click', 10.0::DOUBLE), ('view', 12.0::DOUBLE)) l(provider, capacity) USING (provider)",
)
def _(spark, sf):
    limits = spark.createDataFrame([("click", 10.0), ("view", 12.0)], "provider string, capacity double")
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    used = summaries.rate_usage(e, "event_type", "ts", limits, 6 * 3600)
    return used.select(
        "provider", F.unix_micros("window_start").alias("window_us"), "n_requests", "capacity",
        r6("used_share").alias("used_share"), "over_limit",
    )


LINE = FLAT.format("text")


@query(
    "e1_rewrite_file",
    f"""
    WITH lines AS (SELECT {sql_strip('t')} AS t FROM (SELECT {LINE} AS t FROM documents)),
    ok AS (SELECT * FROM lines WHERE t <> '')
    SELECT count(*) AS total, count(*) AS successful, CAST(0 AS BIGINT) AS fallback, CAST(0 AS BIGINT) AS failed,
      1.0::DOUBLE AS success_rate, CAST(0 AS BIGINT) AS quarantined,
      3 * count(*) AS report_lines FROM ok
    """,
)
def _(spark, sf):
    base = scratch_dir(spark, "file")
    table(spark, sf, "documents").select(flat("text")).write.text(base + "/in")
    store = ResultsStore(spark, base + "/store")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    outcome, bad = jobs.rewrite_file(spark, base + "/in", base + "/report", store, now)
    # one tagged union and one aggregate: no join of single rows
    quarantined = bad.agg(F.count("*").alias("quarantined"))
    written = spark.read.text(base + "/report").agg(F.count("*").alias("report_lines"))
    parts = outcome.unionByName(quarantined, allowMissingColumns=True).unionByName(written, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])

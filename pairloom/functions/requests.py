"""Prompts, payloads, replies, keys and error records as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions.text import strip_text

CHAT_REPLY_SCHEMA = "choices array<struct<message:struct<content:string>>>"
CANDIDATE_REPLY_SCHEMA = (
    "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>, text string"
)


def non_blank(text: Column) -> Column:
    """Trimmed text, NULL if nothing is left."""
    return F.nullif(strip_text(text), F.lit(""))


def build_prompt(text: Column, kind: str = "rewrite") -> Column:
    if kind == "rewrite":
        return F.concat(F.lit(C.REWRITE_PROMPT), text)
    if kind == "seq2seq":
        return F.concat(F.lit(C.SEQ2SEQ_PREFIX), text)
    if kind == "classify":
        return F.concat(F.lit(C.CLASSIFY_PROMPT_HEAD), text, F.lit(C.CLASSIFY_PROMPT_TAIL))
    raise ValueError(f"unknown prompt kind {kind!r}")


def build_chat_payload(model: Column, prompt: Column) -> Column:
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(
        F.struct(model.alias("model"), F.array(message).alias("messages"), F.lit(0.0).alias("temperature"))
    )


def extract_chat_content(status: Column, body: Column) -> Column:
    """First choice's text of a successful reply, else NULL."""
    reply = F.from_json(body, CHAT_REPLY_SCHEMA)
    content = F.get(reply["choices"], F.lit(0))["message"]["content"]
    return F.when(status == 200, non_blank(content))


def extract_candidate_text(body: Column) -> Column:
    """First non-empty part of the first candidate, else the plain text, else ''."""
    reply = F.from_json(body, CANDIDATE_REPLY_SCHEMA)
    parts = F.get(reply["candidates"], F.lit(0))["content"]["parts"]["text"]
    return F.coalesce(F.get(F.filter(parts, lambda t: t != ""), F.lit(0)), reply["text"], F.lit(""))


def normalize_label(reply: Column) -> Column:
    """'0' or '1' if exactly one of the digits occurs in the reply, else NULL."""
    zero, one = F.contains(reply, F.lit("0")), F.contains(reply, F.lit("1"))
    return F.when(zero & ~one, F.lit("0")).when(one & ~zero, F.lit("1"))


def result_status(result: Column) -> Column:
    return (
        F.when(result.isNull(), F.lit("failed"))
        .when(result.isin(*C.FALLBACK_REPLIES), F.lit("fallback"))
        .otherwise(F.lit("ok"))
    )


def canonical_provider(provider: Column) -> Column:
    """Lower-cased provider name; missing or empty means the default one."""
    return F.lower(F.coalesce(F.nullif(provider, F.lit("")), F.lit(C.DEFAULT_PROVIDER)))


def cache_key(columns: Mapping[str, Column], operation: str, prefix: str = C.MEMO_PREFIX) -> Column:
    """``prefix:md5`` of canonical JSON of the operation and its named arguments.

    Names are sorted, so the order of the arguments does not matter.
    """
    args = F.struct(*[columns[n].cast("string").alias(n) for n in sorted(columns)])
    body = F.to_json(F.struct(F.lit(operation).alias("op"), args.alias("args")), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix + ":"), F.md5(body))


def backoff_delay(attempt: Column, delay: float = C.RETRY_DELAY) -> Column:
    """Seconds to wait after the given failed attempt (0-based)."""
    return F.lit(delay) * F.pow(F.lit(2.0), attempt)


def report_block(original: Column, result: Column) -> Column:
    shown = F.coalesce(F.nullif(result, F.lit("")), F.lit("FAILED"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Original: "), original),
        F.concat(F.lit("Paraphrase: "), shown),
        F.lit(C.REPORT_RULE),
    )


def classify_error(
    status: Column, kind: Column, message: Column, provider: Column, retry_after: Column | None = None
) -> Column:
    """Error record of a failed call: code, message, details, original error.

    ``status`` is the HTTP status if there was a response, ``kind`` one of
    ``connection``, ``timeout`` or anything else.
    """
    def named(prefix: str) -> Column:
        return F.concat(F.lit(prefix), F.upper(provider))

    has_status = status.isNotNull()
    code = (
        F.when(status == 401, named("AUTH_ERROR_"))
        .when(status == 429, named("RATE_LIMIT_"))
        .otherwise(named("API_ERROR_"))
    )
    text = (
        F.when(status == 401, F.concat(F.lit("Authentication failed for provider: "), provider))
        .when(status == 429, F.concat(F.lit("Rate limit exceeded for provider: "), provider))
        .when(has_status, message)
        .when(kind == "connection", F.lit("Connection error"))
        .when(kind == "timeout", F.lit("Request timeout"))
        .otherwise(message)
    )
    wait = retry_after.cast("string") if retry_after is not None else F.lit(None).cast("string")
    base = F.create_map(F.lit("provider"), provider)
    details = (
        F.when(status == 401, base)
        .when(status == 429, F.map_concat(base, F.create_map(F.lit("retry_after"), wait)))
        .otherwise(F.map_concat(base, F.create_map(F.lit("status_code"), status.cast("string"))))
    )
    return F.struct(
        code.alias("error_code"),
        text.alias("message"),
        details.alias("details"),
        message.alias("original_error"),
    )


def http_outcome(error_class: Column) -> Column:
    """HTTP status for an error class; NULL (no error) is 200."""
    return (
        F.when(error_class.isNull(), F.lit(200))
        .when(error_class == "validation", F.lit(400))
        .when(error_class == "not_found", F.lit(404))
        .when(error_class == "api", F.lit(502))
        .otherwise(F.lit(500))
    )

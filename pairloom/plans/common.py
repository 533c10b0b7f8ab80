"""Shared pieces of the registered queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.operators.pairing import next_turn_pairs
from pairloom.session import text_parts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, the SQL that must agree with it."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Text columns mean much work per byte. A session that knows its files to be few can ask for so many tasks on them;
# without the setting a table is read as its files are split.
TEXT_TASKS = "spark.pairloom.textTasks"
TEXTS = {"documents": "doc_id", "conversations": "conv_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(TEXT_TASKS, None)
    return df.repartition(int(tasks), TEXTS[name]) if tasks and name in TEXTS else df


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def big(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_turn_pairs(table(spark, sf_dir, "conversations"))


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the next one: long texts, all of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("original"))
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("original").alias("paraphrase"))
    # a task's texts, and the counts that are made of them, are bounded however large the table
    parts = text_parts(d, "original")
    return d.repartition(parts, "doc_id").join(following.repartition(parts, "doc_id"), "doc_id")


# --- SQL snippets -----------------------------------------------------------

PAIRS = (
    "(SELECT o.conv_id, o.turn, o.text AS original, p.text AS paraphrase FROM conversations o "
    "JOIN conversations p ON p.conv_id = o.conv_id AND p.turn = o.turn + 1 "
    "WHERE o.role = 'user' AND p.role = 'assistant')"
)
DOC_PAIRS = (
    "(SELECT o.doc_id, o.text AS original, p.text AS paraphrase FROM documents o "
    "JOIN documents p ON p.doc_id = o.doc_id + 1)"
)
SPACE = C.WHITESPACE_CLASS
PUNCT = r"[!-/:-@\[-`{-~]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def sql_no_punct(x: str) -> str:
    return f"regexp_replace({x}, '{PUNCT}', '', 'g')"


def sql_split(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda w: w <> '')"


def sql_tokens(x: str) -> str:
    return sql_split(f"lower({sql_no_punct(x)})")


def sql_norm(x: str) -> str:
    stop = "[" + ", ".join(quoted(w) for w in C.STOPWORDS) + "]"
    gaps = SPACE[:-1] + C.TYPOGRAPHIC_QUOTES + "]"
    words = f"string_split_regex(lower({sql_no_punct(x)}), '{gaps}+')"
    return (
        f"list_filter({words}, lambda w: regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+') AND NOT list_contains({stop}, w))"
    )


def sql_sentences(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '[.!?]+'), lambda s: NOT regexp_full_match(s, '{SPACE}*')))"


def sql_scores(pairs: str, keys: str) -> str:
    """CTEs ending in ``scored``: the evaluation record of each pair."""
    on = ", ".join(keys.split(","))
    return f"""
    pairs AS (SELECT * FROM {pairs}),
    tok AS (
      SELECT {on}, 0 AS side, unnest({sql_norm('original')}) AS token FROM pairs
      UNION ALL SELECT {on}, 1 AS side, unnest({sql_norm('paraphrase')}) AS token FROM pairs),
    cnt AS (
      SELECT {on}, token, count(*) FILTER (side = 0) AS n_o, count(*) FILTER (side = 1) AS n_p
      FROM tok GROUP BY {on}, token),
    lex AS (
      SELECT {on},
        coalesce(CAST(sum(n_o * n_p) AS DOUBLE) / nullif(sqrt(sum(n_o * n_o)) * sqrt(sum(n_p * n_p)), 0), 0) AS lexical,
        coalesce(CAST(count(*) FILTER (n_o > 0 AND n_p > 0) AS DOUBLE) / nullif(count(*) FILTER (n_o > 0), 0), 0) AS overlap,
        CAST(count(*) FILTER (n_o > 0 AND n_p > 0) AS DOUBLE) / count(*) AS jaccard
      FROM cnt GROUP BY {on}),
    words AS (
      SELECT *, {sql_split('original')} AS wo, {sql_split('paraphrase')} AS wp FROM pairs),
    shape AS (
      SELECT * EXCLUDE (wo, wp),
        coalesce(CAST(least(len(wo), len(wp)) AS DOUBLE) / nullif(greatest(len(wo), len(wp)), 0), 0) AS length_ratio,
        abs(coalesce(CAST(length(array_to_string(wo, '')) AS DOUBLE) / nullif(len(wo), 0), 0)
          - coalesce(CAST(length(array_to_string(wp, '')) AS DOUBLE) / nullif(len(wp), 0), 0)) AS avg_word_length_diff,
        abs({sql_sentences('original')} - {sql_sentences('paraphrase')}) AS sentence_count_diff
      FROM words),
    scored AS (
      SELECT shape.*, coalesce(lexical, 0) AS lexical_similarity, coalesce(overlap, 0) AS word_overlap,
        coalesce(jaccard, 0) AS jaccard_similarity,
        (0.3 * (1 - abs(coalesce(lexical, 0) - 0.3) / 0.7) + 0.2 * (1 - coalesce(overlap, 0)) + 0.2 * length_ratio) / 0.7
          AS overall_score
      FROM shape LEFT JOIN lex USING ({on}))
    """

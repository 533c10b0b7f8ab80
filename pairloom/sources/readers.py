"""Texts, pairs and request logs as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import strip_text
from pairloom.operators.ordered import ranked

PAIR_SCHEMA = "text1 string, text2 string"
LOG_SCHEMA = (
    "event string, logger string, level string, timestamp string, function string, "
    "execution_time string, error string, error_type string"
)


def read_pairs_tsv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Headerless tab-separated pairs; ``NA`` stays text, doubled quotes are one."""
    return spark.read.csv(
        path if isinstance(path, str) else list(path), schema=PAIR_SCHEMA, sep="\t", quote='"', escape='"',
        header=False, multiLine=False, mode="PERMISSIVE",
    )


def read_splits(spark: SparkSession, train: str, evaluation: str) -> DataFrame:
    """Both files in one table with a ``split`` column; a missing file fails."""
    return (
        read_pairs_tsv(spark, train).withColumn("split", F.lit("train"))
        .unionByName(read_pairs_tsv(spark, evaluation).withColumn("split", F.lit("eval")))
    )


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed text per line; blank lines are dropped."""
    line = strip_text(F.col("value"))
    return spark.read.text(path).select(line.alias("text")).where(F.col("text") != "")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, text) of the non-blank lines, numbered from 0 in file order."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        strip_text(F.col("value")).alias("text"),
    )
    numbered = ranked(lines.where(F.col("text") != ""), [], ["_file", "_block", "_row"], "_rn")
    return numbered.select((F.col("_rn") - 1).alias("pos"), "text")


def texts_from_list(spark: SparkSession, texts: str | Sequence[str], batch_id: str = "batch") -> DataFrame:
    """A single text or a list becomes (batch_id, pos, text)."""
    rows = [texts] if isinstance(texts, str) else list(texts)
    return spark.createDataFrame(
        [(batch_id, i, t) for i, t in enumerate(rows)], "batch_id string, pos bigint, text string"
    )


def texts_from_arrays(df: DataFrame, batch: str, texts: str) -> DataFrame:
    """The same for a table with one array of texts per batch."""
    return df.select(F.col(batch).alias("batch_id"), F.posexplode(texts).alias("pos", "text")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def parse_request_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log lines (``time - logger - level - {json}`` or bare JSON) to typed rows.

    Works on batch and streaming lines; lines without a record are dropped.
    """
    body = F.regexp_extract(column, r"(\{.*\})\s*$", 1)
    rows = lines.select(F.from_json(body, LOG_SCHEMA).alias("r")).where(F.col("r").isNotNull()).select("r.*")
    return rows.where(F.col("event").isNotNull()).select(
        "event", "logger", "level", F.try_to_timestamp("timestamp").alias("ts"), "function",
        F.regexp_replace("execution_time", "s$", "").try_cast("double").alias("seconds"),
        F.when(F.col("level") == "error", F.lit("failed")).otherwise(F.lit("completed")).alias("outcome"),
        "error",
    )


def read_request_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return parse_request_log(reader.text(path))

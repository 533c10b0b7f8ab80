"""Reports and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.requests import report_block


def report_rows(df: DataFrame, original: str = "text", result: str = "result") -> DataFrame:
    return df.withColumn("block", report_block(F.col(original), F.col(result)))


def write_report_text(
    df: DataFrame, path: str, order: Sequence[str] = ("pos",), original: str = "text", result: str = "result"
) -> None:
    """Three lines per pair in input order; file names sort like their content."""
    report_rows(df, original, result).orderBy(*order).select("block").write.mode("overwrite").text(path)


def result_records(df: DataFrame, original: str = "text", result: str = "result", keep: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *keep, F.col(original).alias("original"), F.col(result).alias("paraphrase"),
        F.col(result).isNotNull().alias("success"),
    )


def write_results(df: DataFrame, path: str, fmt: str = "parquet", keep: Sequence[str] = ()) -> None:
    result_records(df, keep=keep).write.mode("overwrite").format(fmt).save(path)

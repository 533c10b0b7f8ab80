"""Row and batch validation; invalid rows are marked, not lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions.text import is_blank, strip_text


def text_violation(text: Column, max_chars: int | None = C.MAX_TEXT_CHARS) -> Column:
    """First rule that the text breaks, NULL if it is valid; ``max_chars`` None sets no length."""
    broken = (
        F.when(text.isNull(), F.lit(C.NOT_A_STRING))
        .when(is_blank(text), F.lit(C.EMPTY_TEXT))
    )
    return broken if max_chars is None else broken.when(F.length(text) > max_chars, F.lit(C.TEXT_TOO_LONG))


def validate_texts(df: DataFrame, text: str = "text", max_chars: int | None = C.MAX_TEXT_CHARS) -> DataFrame:
    return df.withColumn("violation", text_violation(F.col(text), max_chars))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) of a validated table."""
    bad = F.col("violation").isNotNull()
    return df.where(~bad).drop("violation"), df.where(bad)


def validate_batch_size(
    items: DataFrame, batch: str = "batch_id", limit: int = C.MAX_BATCH_TEXTS, batches: DataFrame | None = None
) -> DataFrame:
    """Size and violation per batch; ``batches`` lists batches that may be empty."""
    sizes = items.groupBy(batch).agg(F.count("*").alias("n_texts"))
    if batches is not None:
        sizes = batches.select(batch).distinct().join(sizes, batch, "left").fillna({"n_texts": 0})
    return sizes.withColumn(
        "violation",
        F.when(F.col("n_texts") == 0, F.lit(C.EMPTY_BATCH)).when(
            F.col("n_texts") > limit, F.lit(C.TOO_MANY_TEXTS.format(limit=limit))
        ),
    )


def validate_request(df: DataFrame, text: str = "text", max_chars: int = C.MAX_TEXT_CHARS) -> DataFrame:
    """Length is checked on the text as sent; the text that passes is trimmed."""
    col = F.col(text)
    violation = (
        F.when(col.isNull(), F.lit(C.NOT_A_STRING))
        .when(F.length(col) > max_chars, F.lit(C.TEXT_TOO_LONG))
        .when(is_blank(col), F.lit(C.EMPTY_TEXT))
    )
    return df.withColumn("violation", violation).withColumn(text, strip_text(col))


def validate_eval_pairs(
    originals: DataFrame, rewrites: DataFrame, on: tuple[str, ...] = ("batch_id", "pos"), text: str = "text"
) -> DataFrame:
    """Pairs with a violation: a side missing or blank. Texts are trimmed."""
    left = originals.select(*on, F.col(text).alias("original"), F.lit(True).alias("_l"))
    right = rewrites.select(*on, F.col(text).alias("paraphrase"), F.lit(True).alias("_r"))
    both = left.join(right, list(on), "full_outer")
    violation = (
        F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.lit("length mismatch"))
        .when(F.col("original").isNull() | is_blank(F.col("original")), F.lit("original is empty"))
        .when(F.col("paraphrase").isNull() | is_blank(F.col("paraphrase")), F.lit("paraphrase is empty"))
    )
    return both.select(
        *on, strip_text(F.col("original")).alias("original"), strip_text(F.col("paraphrase")).alias("paraphrase"),
        violation.alias("violation"),
    )

"""Whole jobs: a text file to a report, position-paired texts to scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.operators.evaluate import evaluate_batch, evaluation_summary
from pairloom.operators.generate import memoized_transform, offline_reply
from pairloom.operators.pairing import pair_by_position
from pairloom.operators.store import ResultsStore
from pairloom.operators.summaries import batch_outcome
from pairloom.operators.validate import split_valid, validate_texts
from pairloom.session import scratch_dir
from pairloom.sources.readers import read_numbered_lines
from pairloom.sources.writers import write_report_text


def rewrite_file(
    spark: SparkSession,
    path: str,
    report: str,
    store: ResultsStore,
    now: Column,
    fn: Callable[[str], str | None] = offline_reply,
    ttl: int | None = C.MEMO_TTL_SECONDS,
    max_chars: int | None = None,
    **calls,
) -> tuple[DataFrame, DataFrame]:
    """Lines of a file to a report in line order; (outcome, quarantined lines).

    Results are written once and read from there by both the report and the
    outcome. Lines of any length are rewritten unless ``max_chars`` is given.
    """
    valid, bad = split_valid(validate_texts(read_numbered_lines(spark, path), max_chars=max_chars))
    done = scratch_dir(spark, "rewrites")
    memoized_transform(valid, store, now, fn, ttl=ttl, **calls).write.parquet(done)
    results = spark.read.parquet(done)
    write_report_text(results, report)
    return batch_outcome(results, by=()), bad


def score_texts(
    originals: DataFrame,
    rewrites: DataFrame,
    on: tuple[str, ...] = ("batch_id", "pos"),
    semantic: Column | None = None,
    by: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(evaluation record of each pair, summary). Both sides must be complete."""
    scored = evaluate_batch(pair_by_position(originals, rewrites, on), semantic)
    return scored, evaluation_summary(scored, by)

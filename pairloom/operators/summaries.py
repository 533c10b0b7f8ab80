"""Outcome, job, request, latency, cache and usage reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions.requests import result_status


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def batch_outcome(results: DataFrame, by: Sequence[str] = ("batch_id",), result: str = "result") -> DataFrame:
    """Totals per batch; a non-NULL result is a success, also a fallback text."""
    sums = results.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count(result).alias("successful"),
        F.count_if(result_status(F.col(result)) == "fallback").alias("fallback"),
    )
    return sums.withColumns({
        "failed": F.col("total") - F.col("successful"), "success_rate": rate(F.col("successful"), F.col("total")),
    })


def job_status(jobs: DataFrame, items: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per job: status, counts, success rate, duration.

    ``jobs`` (job_id, status, created_at, completed_at), ``items`` (job_id, pos, result), ``errors`` (job_id,
    error, at). Results and errors of a job of any size are rows: see ``job_results`` and ``job_errors``.
    Further columns of ``jobs`` stay.
    """
    counts = items.groupBy("job_id").agg(F.count("*").alias("total_items"), F.count("result").alias("successful"))
    failures = errors.groupBy("job_id").agg(F.count("*").alias("job_errors"))
    own = [c for c in jobs.columns if c not in ("job_id", "status", "created_at", "completed_at")]
    sized = jobs.join(counts, "job_id", "left").join(failures, "job_id", "left")
    sized = sized.fillna({"total_items": 0, "successful": 0, "job_errors": 0})
    return sized.select(
        "job_id", "status", "total_items", "successful", (F.col("total_items") - F.col("successful")).alias("failed_items"),
        F.col("job_errors").cast("bigint").alias("job_errors"), rate(F.col("successful"), F.col("total_items")).alias("success_rate"),
        "created_at", "completed_at",
        (F.col("completed_at").cast("double") - F.col("created_at").cast("double")).alias("processing_time"), *own,
    )


def job_results(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """(job_id, pos, result) of completed jobs, however many; order by job and ``pos`` to read them."""
    done = jobs.where(F.col("status") == "completed").select("job_id")
    return items.join(done, "job_id", "left_semi").select("job_id", "pos", "result")


def job_errors(jobs: DataFrame, errors: DataFrame) -> DataFrame:
    """(job_id, at, error) of the given jobs, however many."""
    return errors.join(jobs.select("job_id"), "job_id", "left_semi").select("job_id", "at", "error")


def split_sizes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("split").agg(F.count("*").alias("n_rows"))


def request_metrics(
    requests: DataFrame, failed: Column, seconds: Column, hit: Column, by: Sequence[str] = ()
) -> DataFrame:
    return requests.groupBy(*by).agg(
        F.count("*").alias("requests_total"),
        F.count_if(~failed).alias("requests_successful"),
        F.count_if(failed).alias("requests_failed"),
        F.coalesce(F.avg(seconds), F.lit(0.0)).alias("average_response_time"),
        F.coalesce(F.avg(hit.cast("int")), F.lit(0.0)).alias("cache_hit_rate"),
    )


def function_latency(log: DataFrame) -> DataFrame:
    """Per function and outcome of a request log (see ``read_request_log``)."""
    return log.groupBy("function", "outcome").agg(
        F.count("*").alias("n_calls"),
        F.avg("seconds").alias("avg_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.count("error").alias("n_errors"),
    )


def cache_stats(replayed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hits, misses and hit rate of a replayed request table."""
    sums = replayed.groupBy(*by).agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count("*").alias("requests")
    )
    return sums.withColumn("hit_rate", rate(F.col("hits"), F.col("requests")))


def store_stats(store: DataFrame, now: Column) -> DataFrame:
    dead = F.coalesce(now > F.col("expires_at"), F.lit(False))
    return store.agg(F.count_if(~dead).alias("live_entries"), F.count_if(dead).alias("expired_entries"))


def rate_usage(requests: DataFrame, provider: str, ts: str, limits: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests per provider and window against the provider's capacity."""
    used = requests.groupBy(F.col(provider).alias("provider"), F.window(ts, f"{seconds} seconds").alias("w")).agg(
        F.count("*").alias("n_requests")
    )
    return used.join(limits.select("provider", "capacity"), "provider", "left").select(
        "provider", F.col("w.start").alias("window_start"), "n_requests", "capacity",
        (F.col("n_requests") / F.col("capacity")).alias("used_share"),
        (F.col("n_requests") > F.col("capacity")).alias("over_limit"),
    )

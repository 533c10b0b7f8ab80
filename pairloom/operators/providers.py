"""Provider dimension: models, features, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions.requests import canonical_provider, non_blank


def providers(spark: SparkSession) -> DataFrame:
    """provider, model, features, capacity, refill: one row per known provider."""
    rows = [(n, p["model"], p["features"], p["capacity"], p["refill"]) for n, p in C.PROVIDERS.items()]
    return spark.createDataFrame(
        rows, "provider string, default_model string, features array<string>, capacity double, refill double"
    )


def provider_features(spark: SparkSession) -> DataFrame:
    return providers(spark).select(
        "provider", F.explode("features").alias("feature"), (F.col("provider") == C.DEFAULT_PROVIDER).alias("is_default")
    )


def resolve_model(
    requests: DataFrame, provider: str = "provider", explicit: str = "model", settings: DataFrame | None = None
) -> DataFrame:
    """Adds ``model_name``: explicit, then override, file value and default.

    ``settings`` (provider, override, file_value) is looked up per run. A
    provider that is not known follows the default provider's chain.
    """
    dim = providers(requests.sparkSession).select("provider", "default_model")
    if settings is None:
        chain = dim.select(F.col("provider").alias("_chain"), F.col("default_model").alias("_configured"))
    else:
        chain = dim.join(settings, "provider", "left").select(
            F.col("provider").alias("_chain"),
            F.coalesce(non_blank(F.col("override")), non_blank(F.col("file_value")), F.col("default_model")).alias(
                "_configured"
            ),
        )
    name = canonical_provider(F.col(provider))
    known = F.when(name.isin(*C.PROVIDERS), name).otherwise(F.lit(C.DEFAULT_PROVIDER))
    # One row per known provider, a fixed handful.
    return (
        requests.withColumn("_chain", known)
        .join(F.broadcast(chain), "_chain", "left")
        .withColumn("model_name", F.coalesce(non_blank(F.col(explicit)), F.col("_configured")))
        .drop("_chain", "_configured")
    )


def with_limits(requests: DataFrame, provider: str = "provider", limits: DataFrame | None = None) -> DataFrame:
    """Adds capacity and refill; NULL for a provider without a limit."""
    dim = (providers(requests.sparkSession) if limits is None else limits).select(
        F.col("provider").alias(provider), "capacity", "refill"
    )
    return requests.join(dim, provider, "left")

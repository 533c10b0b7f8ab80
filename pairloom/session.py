"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 32 << 20  # of text in a partition


def builder(app: str = "pairloom", master: str | None = None) -> SparkSession.Builder:
    """A session builder with the settings the jobs here rely on."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    return b.master(master) if master else b


def scratch_base(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine:
    on a cluster the executors could not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder name under the scratch folder."""
    return f"{scratch_base(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives the loss of executors."""
    spark = df.sparkSession
    base = scratch_base(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)



def text_parts(df: DataFrame, *texts: str) -> int:
    """Into how many partitions rows with these texts are dealt: of about ``PART_BYTES`` of text, but no fewer than the session's."""
    held: Column = F.lit(0).cast("bigint")
    for t in texts:
        held = held + F.coalesce(F.octet_length(F.col(t)), F.lit(0))
    size = df.agg(F.sum(held)).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)

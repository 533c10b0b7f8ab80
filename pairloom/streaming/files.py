"""File streams in, exactly-once Parquet out."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pairloom.session import scratch_dir

if TYPE_CHECKING:
    from pairloom.streaming.admission import Admission


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet files in folder ``path`` (or one file) as a stream; event times become TIMESTAMP.

    ``max_files`` bounds a micro-batch, and with it every group of its rows.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        # A file source watches folders: watch the parent for this one file.
        rows = reader.option("pathGlobFilter", hadoop.getName()).parquet(hadoop.getParent().toString())
    else:
        rows = reader.parquet(path)
    zoneless = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def append_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Start a query that appends to ``path``; the file sink and its checkpoint
    record each micro-batch once, also after a restart."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def run_to_table(stream: DataFrame | Admission, label: str) -> DataFrame:
    """Process everything that is there now and return the written rows."""
    if not isinstance(stream, DataFrame):
        return stream.run(scratch_dir(stream.stream.sparkSession, label))
    spark = stream.sparkSession
    path = scratch_dir(spark, label)
    append_parquet(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def keep_latest(stream: DataFrame, path: str, available_now: bool = True):
    """Start a query that writes each micro-batch's changed groups of an aggregation to ``path``.

    A micro-batch that is run again replaces its own folder. Read the groups with ``latest_of``.
    """
    def save(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    writer = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_of(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """Every group as its last micro-batch left it, open windows included."""
    named = StructType([*schema.fields, StructField("batch", LongType())])
    rows = spark.read.schema(named).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in schema.names if c not in keys]).select(*schema.names)


def run_to_latest(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Process everything that is there now and return every group; nothing is held by the driver."""
    path = scratch_dir(stream.sparkSession, label)
    keep_latest(stream, path).awaitTermination()
    return latest_of(stream.sparkSession, path, stream.schema, keys)

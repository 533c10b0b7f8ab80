"""Results store: remembered values with an optional time to live.

Entries are rows (key, value, created_at, expires_at); ``expires_at`` NULL
never expires. The functions work on DataFrames; :class:`ResultsStore` keeps
them as Parquet folders under a shared path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairloom import constants as C
from pairloom.operators.lookup import lookup
from pairloom.operators.ordered import ranked

ENTRY = ["key", "value", "created_at", "expires_at"]
ENTRY_SCHEMA = "key string, value string, created_at timestamp, expires_at timestamp"


def is_live(now: Column) -> Column:
    """An entry is still live at the very instant it expires."""
    return F.col("expires_at").isNull() | (now <= F.col("expires_at"))


def live(store: DataFrame, now: Column) -> DataFrame:
    return store.where(is_live(now))


def new_entries(values: DataFrame, now: Column, ttl: int | None = C.MEMO_TTL_SECONDS) -> DataFrame:
    """Entries for (key, value); a ttl of None or 0 never expires."""
    dies = now + F.make_dt_interval(secs=F.lit(float(ttl))) if ttl else F.lit(None)
    return values.select("key", "value", now.alias("created_at"), dies.cast("timestamp").alias("expires_at"))


def latest(entries: DataFrame, order: Column) -> DataFrame:
    """Last entry per key. Partial maxima are taken before the shuffle, so a key
    that was written often is no hot key; each column is picked by itself, so
    values that nobody reads are not shuffled."""
    return entries.groupBy("key").agg(*[F.max_by(c, order).alias(c) for c in ENTRY if c != "key"])


def _write_order(*before: str) -> Column:
    return F.struct(*before, "created_at", F.coalesce("value", F.lit("")))


def store_upsert(store: DataFrame, entries: DataFrame) -> DataFrame:
    """The store after writing the entries; the last write of a key wins."""
    both = store.select(*ENTRY, F.lit(0).alias("_v")).unionByName(entries.select(*ENTRY, F.lit(1).alias("_v")))
    return latest(both, _write_order("_v"))


def cache_lookup(requests: DataFrame, store: DataFrame, now: Column, hot: DataFrame | None = None) -> DataFrame:
    """Adds ``value`` and ``hit`` to each request."""
    found = live(store, now).select("key", "value", F.lit(True).alias("_hit"))
    return lookup(requests, found, "key", "left", hot).withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def cache_exists(requests: DataFrame, store: DataFrame, now: Column) -> DataFrame:
    return lookup(requests, live(store, now).select("key"), "key", "left_semi")


def cache_misses(requests: DataFrame, store: DataFrame, now: Column) -> DataFrame:
    return lookup(requests, live(store, now).select("key"), "key", "left_anti")


def two_tier_lookup(
    requests: DataFrame, primary: DataFrame, secondary: DataFrame, now: Column, keep_ttl: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(requests with value and tier, entries to promote into the primary).

    Promoted entries lose their time to live unless ``keep_ttl``.
    """
    p = live(primary, now).select("key", F.col("value").alias("_p"))
    s = live(secondary, now).select("key", F.col("value").alias("_s"), F.col("expires_at").alias("_e"))
    both = lookup(lookup(requests, p, "key"), s, "key")
    from_second = F.col("_p").isNull() & F.col("_s").isNotNull()
    tier = F.when(F.col("_p").isNotNull(), F.lit("primary")).when(from_second, F.lit("secondary"))
    answers = both.withColumns({"value": F.coalesce("_p", "_s"), "tier": tier}).drop("_p", "_s", "_e")
    dies = F.col("_e") if keep_ttl else F.lit(None).cast("timestamp")
    # The wanted keys first: one row per key, however often it is asked for.
    wanted = requests.select("key").distinct()
    promoted = (
        s.join(wanted, "key", "left_semi")
        .join(p, "key", "left_anti")
        .select("key", F.col("_s").alias("value"), now.alias("created_at"), dies.alias("expires_at"))
    )
    return answers, promoted


def cache_delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key"), "key", "left_anti")


def store_purge_expired(store: DataFrame, now: Column) -> DataFrame:
    return live(store, now)


def store_compact(store: DataFrame, now: Column, max_rows: int) -> DataFrame:
    """A store of ``max_rows`` or more loses its expired entries; if still as many are left, also the quarter created first.

    A store with fewer rows stays as it is. Only creation time and key are ranked, to find the last entry to go; the store is then
    filtered by it.
    """
    if store.count() < max_rows:
        return store
    kept = store_purge_expired(store, now)
    n = kept.count()
    if n < max_rows or n < 4:
        return kept
    last = ranked(kept.select("created_at", "key"), [], ["created_at", "key"], "_rn").where(F.col("_rn") == n // 4).first()
    at, key = F.lit(last["created_at"]), F.lit(last["key"])
    return kept.where((F.col("created_at") > at) | (F.col("created_at") == at) & (F.col("key") > key))


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, whatever store it lies in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the folders ``<prefix><number>`` in a folder, in order."""
    path, fs = _hadoop(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder was committed."""
    path, fs = _hadoop(spark, f"{folder}/_SUCCESS")
    return fs.exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    path, fs = _hadoop(spark, folder)
    fs.delete(path, True)


class EpochLog:
    """What each micro-batch of a stream decided, one folder ``epoch=N`` each.

    A micro-batch that runs again finds what it decided before, if that was committed, and replaces it otherwise.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folder(self, epoch: int) -> str:
        return f"{self.path}/epoch={epoch}"

    def write(self, rows: DataFrame, epoch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.folder(epoch))
        return self.spark.read.schema(rows.schema).parquet(self.folder(epoch))

    def read(self, epoch: int, schema: str | StructType) -> DataFrame | None:
        """The rows of a committed epoch, else None."""
        if epoch < 0 or not finished(self.spark, self.folder(epoch)):
            return None
        return self.spark.read.schema(schema).parquet(self.folder(epoch))

    def last(self, before: int) -> int:
        """The last committed epoch before a number, -1 if there is none."""
        done = [n for n in numbered(self.spark, self.path, "epoch=") if n < before]
        return next((n for n in reversed(done) if finished(self.spark, self.folder(n))), -1)

    def forget(self, before: int) -> None:
        """Remove the epochs before a number: only the last one can be run again."""
        for n in numbered(self.spark, self.path, "epoch="):
            if n < before:
                remove(self.spark, self.folder(n))


class ResultsStore:
    """A store in ``path/gen=G/ver=V``: one folder per write.

    Writing appends a version and rewriting starts a generation; readers use
    the last generation and the versions in it that finished. A version that is
    written again under its number replaces itself, so a retried write is safe.
    After ``max_versions`` writes the versions are merged to a generation; of the
    earlier ones the last ``KEPT`` stay for readers that began with them. One
    writer at a time.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, path: str, max_versions: int = 64):
        self.spark, self.path, self.max_versions = spark, path.rstrip("/"), max_versions

    def _finished(self, gen: int) -> list[int]:
        folder = f"{self.path}/gen={gen}"
        return [v for v in numbered(self.spark, folder, "ver=") if finished(self.spark, f"{folder}/ver={v}")]

    def _current(self) -> tuple[int, list[int]]:
        for gen in reversed(numbered(self.spark, self.path, "gen=")):
            versions = self._finished(gen)
            if versions:
                return gen, versions
        return 0, []

    def read(self) -> DataFrame:
        gen, versions = self._current()
        if not versions:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        base = f"{self.path}/gen={gen}"
        schema = ENTRY_SCHEMA + ", ver int"
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/ver={v}" for v in versions])
        if len(versions) == 1:
            return rows.select(*ENTRY)  # a single write holds each key once
        return latest(rows, F.col("ver"))

    def put(self, entries: DataFrame, version: int | None = None) -> None:
        """Append entries; within one write the latest entry of a key counts."""
        gen, versions = self._current()
        number = max(versions, default=-1) + 1 if version is None else version
        once = latest(entries.select(*ENTRY), _write_order())
        once.write.mode("overwrite").parquet(f"{self.path}/gen={gen}/ver={number}")
        if version is None and len(versions) >= self.max_versions:
            self.rewrite(self.read())

    def rewrite(self, entries: DataFrame) -> None:
        """Publish the given entries as the whole store."""
        gen, _ = self._current()
        entries.select(*ENTRY).write.mode("overwrite").parquet(f"{self.path}/gen={gen + 1}/ver=0")
        for old in numbered(self.spark, self.path, "gen="):
            if old < gen + 1 - self.KEPT:
                remove(self.spark, f"{self.path}/gen={old}")

    def clear(self) -> None:
        self.rewrite(self.spark.createDataFrame([], ENTRY_SCHEMA))

    def delete(self, keys: DataFrame) -> None:
        self.rewrite(cache_delete(self.read(), keys))

    def purge(self, now: Column) -> None:
        self.rewrite(store_purge_expired(self.read(), now))

    def compact(self, now: Column, max_rows: int) -> None:
        self.rewrite(store_compact(self.read(), now, max_rows))

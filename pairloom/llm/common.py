"""Pieces that several operators here share: words, hashes, bounded counters, file passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import cut, scratch_base, scratch_dir

__all__ = ["added_up", "blank_separated", "cut", "dense_counts", "hashed", "in_pieces", "materialise", "mix", "scratch_base", "scratch_dir", "share", "shingles", "slices", "table"]

# Rows of long texts are worked on in slices of at most so many bytes of text.
SLICE_BYTES = 4 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back: computed once, survives lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, thing: object) -> Callable[[], object]:
    """Broadcast an object with its class; each worker process unpacks it once and keeps what it builds in it."""
    held = spark.sparkContext.broadcast({"packed": cloudpickle.dumps(thing)})

    def get() -> object:
        box = held.value
        if "thing" not in box:
            box["thing"] = cloudpickle.loads(box["packed"])
        return box["thing"]

    return get


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text; a longer single row stands alone."""
    for batch in batches:
        rows = batch.num_rows
        share = batch.column(column).nbytes // size + 1
        step = max(1, rows // share)
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def blank_separated(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between blanks and the controls 09 to 0D."""
    return text.encode().lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        moved = h >> np.uint64(shift)
        moved ^= h
        moved *= np.uint64(factor)
        h = moved
    moved = h >> np.uint64(31)
    moved ^= h
    return moved


class WordHashes:
    """64-bit hashes of words. None is remembered: hashing a word again costs less than finding it among many, and takes no memory."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.digest, words), np.uint64, len(words))


def hashed(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return hashes.of(words)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in order; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = words[:n].copy()
    for i in range(1, k):
        h = mix(h)
        h *= _ODD
        h += words[i : n + i]
    return mix(h)


def dense_counts(df: DataFrame, buckets: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """How many rows or members fall in each of ``size`` buckets.

    ``buckets`` turns the batches of a task into arrays of bucket numbers. A task sends one array of
    counts up to 255 in pieces, tasks are added up piece by piece, and the driver gets ``size`` numbers, whatever
    the input. ``size`` must be a multiple of 64.
    """
    def count(batches):
        total = np.zeros(size, np.int32)
        for b in buckets(batches):
            np.add.at(total, b, 1)
        pieces, counts = in_pieces(total)
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array(counts, pa.binary())], ["piece", "counts"])

    return added_up(df.mapInArrow(count, "piece int, counts binary"), size)


PIECES = 64


def in_pieces(total: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Numbers and contents, a byte a count, of the pieces of an array of counts that hold any; a task's counts stop at 255."""
    parts = np.minimum(total, 255).astype(np.uint8).reshape(PIECES, -1)
    filled = [i for i in range(PIECES) if parts[i].any()]
    return filled, [parts[i].tobytes() for i in filled]


def added_up(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays of ``size`` counts that come as ``rows(piece, counts)`` from ``in_pieces``.

    Two rounds: pieces of some tasks each, then the sums of those, so that no task reads many arrays.
    """
    def add(kind):
        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    new = np.frombuffer(raw.as_buffer(), kind).astype(np.int32)
                    sums[piece] = sums[piece] + new if piece in sums else new
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["piece", "counts"])

        return run

    schema, out = "piece int, counts binary", np.zeros((PIECES, size // PIECES), np.int32)
    some = rows.repartition(16, "piece", F.spark_partition_id() % 16).mapInArrow(add(np.uint8), schema)
    for row in some.repartition(4, "piece").mapInArrow(add(np.int32), schema).toLocalIterator():
        out[row.piece] += np.frombuffer(row.counts, np.int32)
    return out.reshape(-1)

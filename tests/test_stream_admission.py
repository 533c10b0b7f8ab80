"""Streams of admission: state in a table, keys of any size, late requests, repeated micro-batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators.admission import replay_cache
from pairloom.operators.bucket import token_bucket_admit
from pairloom.operators.carried import sliding_window_admit
from pairloom.operators.ordered import sorted_chunks
from pairloom.operators.store import numbered
from pairloom.streaming import admission as SA
from pairloom.streaming.files import read_stream, run_to_table

SCHEMA = "id bigint, k string, us bigint, c double"


@pytest.fixture(scope="module")
def traffic():
    """Three batches in the order of time; one key has most of the rows, one is NULL, instants repeat across batches."""
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        k = "hot" if rng.random() < 0.7 else None if rng.random() < 0.2 else f"k{rng.randint(0, 9)}"
        rows.append((i, k, rng.randint(0, 600) * 1_000_000, rng.choice([1.0, 1.0, 2.0, 0.5, 0.25])))
    rows.sort(key=lambda r: (r[2], r[0]))
    return [rows[n : n + 1000] for n in range(0, 3000, 1000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us")).drop("us")


@pytest.fixture(scope="module")
def stream(spark, traffic, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("traffic") / "t")
    for part in traffic:
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
    return read_stream(spark, path, max_files=1)


def whole(c):
    return F.ceil(F.col(c)).cast("bigint")


CASES = {
    "bucket": (lambda d, f: f(d, "k", "ts", "id", 6, 0.2, cost=F.col("c")), SA.stream_token_bucket, token_bucket_admit, "admitted"),
    "never refilled": (lambda d, f: f(d, "k", "ts", "id", 40, 0, cost=F.col("c")), SA.stream_token_bucket, token_bucket_admit, "admitted"),
    "sliding": (lambda d, f: f(d, "k", "ts", "id", 7, 30, cost=whole("c")), SA.stream_sliding_admit, sliding_window_admit, "admitted"),
    "dedupe": (lambda d, f: f(d, "k", "ts", "id", 45), SA.stream_dedupe_ttl, replay_cache, "hit"),
}


@pytest.mark.parametrize("case", CASES)
def test_micro_batches_equal_one_batch(spark, traffic, stream, case):
    call, streamed, batch, value = CASES[case]
    limiter = call(stream, streamed)
    got = run_to_table(limiter, "admission").collect()
    want = {r.id: r for r in call(frame(spark, [r for part in traffic for r in part]), batch).collect()}
    assert len(got) == 3000 and not any(r.late for r in got)
    assert {r.id: r[value] for r in got} == {i: r[value] for i, r in want.items()}
    assert {r.id: r.k for r in got} == {r[0]: r[1] for part in traffic for r in part}
    if value == "admitted":
        assert all(r.retry_after == pytest.approx(want[r.id].retry_after) for r in got)


def test_the_hot_key_spans_chunks(spark, traffic):
    chunks = sorted_chunks(frame(spark, traffic[0]), ["k"], ["ts", "id"])
    assert chunks.where("k = 'hot'").select("chunk").distinct().count() >= 4


def steps(spark, limiter, path, parts):
    """Micro-batches one after the other, without a stream."""
    for n, part in enumerate(parts):
        limiter.step(path, frame(spark, part), n)
    return {r.id: r for r in limiter.read(path).collect()}


def test_late_requests_are_passed_on(spark, stream, tmp_path):
    parts = [[(1, "a", 100_000_000, 1.0), (2, "b", 50_000_000, 1.0)], [(3, "a", 99_000_000, 1.0), (4, "a", 100_000_000, 1.0), (5, "b", 60_000_000, 1.0), (0, "c", 10, 1.0)], [(6, "a", 100_000_000, 1.0)]]
    limiter = SA.stream_token_bucket(stream, "k", "ts", "id", 2, 0, delay="1 hour")
    got = steps(spark, limiter, str(tmp_path / "a"), parts)
    assert {i: (r.admitted, r.late) for i, r in got.items()} == {1: (True, False), 2: (True, False), 3: (None, True), 4: (True, False), 5: (True, False), 0: (True, False), 6: (False, False)}
    # 30 seconds of patience: b and c come too late for the watermark, that a's request has set
    limiter = SA.stream_dedupe_ttl(stream, "k", "ts", "id", 1000, delay="30 seconds")
    got = steps(spark, limiter, str(tmp_path / "b"), parts)
    assert {i: (r.hit, r.late) for i, r in got.items()} == {1: (False, False), 2: (False, False), 3: (None, True), 4: (True, False), 5: (None, True), 0: (None, True), 6: (True, False)}


def test_fractional_costs(spark, stream, tmp_path):
    parts = [[(n, "a", n, 0.5)] for n in range(5)]
    got = steps(spark, SA.stream_token_bucket(stream, "k", "ts", "id", 2, 0, cost=F.col("c")), str(tmp_path / "a"), parts)
    assert [got[n].admitted for n in range(5)] == [True] * 4 + [False]
    with pytest.raises(Exception, match="cost must be a whole number"):
        steps(spark, SA.stream_sliding_admit(stream, "k", "ts", "id", 2, 5, cost=F.col("c")), str(tmp_path / "b"), parts[:1])


def test_a_repeated_micro_batch_changes_nothing(spark, traffic, stream, tmp_path):
    limiter = SA.stream_sliding_admit(stream, "k", "ts", "id", 7, 30)
    path = str(tmp_path / "s")
    first = steps(spark, limiter, path, traffic[:2])
    limiter.step(path, frame(spark, traffic[1]), 1)
    again = {r.id: r for r in limiter.read(path).collect()}
    assert again == first
    limiter.step(path, frame(spark, traffic[2]), 2)
    want = {r.id: r.admitted for r in sliding_window_admit(frame(spark, sum(traffic, [])), "k", "ts", "id", 7, 30).collect()}
    assert {r.id: r.admitted for r in limiter.read(path).collect()} == want
    assert numbered(spark, f"{path}/state", "epoch=") == [1, 2]


@pytest.mark.parametrize("kind", ["bucket", "sliding", "dedupe"])
def test_idle_keys_are_forgotten(spark, stream, tmp_path, kind):
    limiter = {
        "bucket": SA.stream_token_bucket(stream, "k", "ts", "id", 5, 1.0, delay="10 seconds"),
        "sliding": SA.stream_sliding_admit(stream, "k", "ts", "id", 5, 20, delay="10 seconds"),
        "dedupe": SA.stream_dedupe_ttl(stream, "k", "ts", "id", 20, delay="10 seconds"),
    }[kind]
    path = str(tmp_path / "f")
    parts = [[(n, f"k{n}", n * 1_000_000, 1.0) for n in range(10)], [(20, "new", 32_000_000, 1.0)], [], [(21, "new", 33_000_000, 1.0)]]
    steps(spark, limiter, path, parts)
    keys = {r.k for r in spark.read.parquet(f"{path}/state/epoch=3").collect()}
    # the watermark is at 23 s: a bucket is full again a second after its request, a window is over after 20
    assert keys == ({"new"} if kind == "bucket" else {"new", *(f"k{n}" for n in range(4 if kind == "sliding" else 3, 10))})


def test_nothing_to_read(spark, stream, tmp_path):
    assert SA.stream_dedupe_ttl(stream, "k", "ts", "id", 1).read(str(tmp_path / "none")).count() == 0

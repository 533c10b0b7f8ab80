import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import bucket as B
from pairloom.operators.bucket import TOKEN, Stretch, refill_units, token_bucket_admit


def plain_level(level, steps, cap):
    for gain, cost in steps:
        level = min(cap, level + gain)
        if level >= cost:
            level -= cost
    return level


def evaluate(pieces, level):
    for lo, hi, shift, v in pieces:
        if lo <= level <= hi:
            return level + v if shift else v
    raise AssertionError("level outside the domain")


def test_stretch_function_equals_plain_fold():
    rng = random.Random(7)
    for case in range(300):
        cap = rng.choice([3, 10, 60, 500])
        unit = rng.choice([1, 2, 7])
        steps = [
            (rng.choice([0, 0, 1, 2, rng.randint(0, 2 * cap)]), unit * rng.choice([1, 1, 2, 5]))
            for _ in range(rng.randint(1, 200))
        ]
        s = Stretch(cap)
        for g, c in steps:
            s.add(g, c)
        pieces = s.pieces()
        assert pieces[0][0] == 0 and pieces[-1][1] == cap
        assert all(a[1] + 1 == b[0] for a, b in zip(pieces, pieces[1:]))
        for level in range(cap + 1):
            assert evaluate(pieces, level) == plain_level(level, steps, cap), (case, level)


def test_stretch_stays_small_when_saturated():
    rng = random.Random(1)
    cap = 60 * TOKEN
    s = Stretch(cap)
    for _ in range(20000):
        s.add(rng.randint(1, 300_000) * 500_000, TOKEN)
    assert len(s.pieces()) <= 200


def plain_bucket(rows, cap, rate):
    level, last, out = cap, None, {}
    for t, i, cost in sorted(rows):
        if last is not None:
            level = min(cap, level + (t - last) * rate)
        last = t
        if level >= cost:
            level -= cost
            out[i] = (True, 0.0)
        else:
            out[i] = (False, (cost - level) / rate / 1e6)
    return out


def test_golden_rows(spark):
    times = [0, 0, 0, 0, 1, 2, 2.5, 10, 10, 10, 10]
    df = spark.createDataFrame([(i, "a", float(t)) for i, t in enumerate(times)], "id bigint, k string, ts double")
    got = token_bucket_admit(df, "k", "ts", "id", 3, 0.5).orderBy("id").collect()
    assert [None if r.admitted else r.retry_after for r in got] == [
        None, None, None, 2.0, 1.0, None, 1.5, None, None, None, 2.0,
    ]


def test_hot_key_over_many_chunks_equals_plain_fold(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        k = "hot" if rng.random() < 0.7 else f"k{rng.randint(0, 40)}"
        rows.append((i, k, rng.randint(0, 400_000_000), float(rng.choice([1, 1, 2, 10]))))
    df = spark.createDataFrame(rows, "id bigint, k string, us bigint, c double").withColumn(
        "ts", F.timestamp_micros("us")
    )
    for rate in (0.5, 30.0, 0.000001):
        got = {
            r.id: (r.admitted, r.retry_after)
            for r in token_bucket_admit(df.repartition(16), "k", "ts", "id", 12, rate, cost=F.col("c")).collect()
        }
        want = {}
        for k in {r[1] for r in rows}:
            mine = [(t, i, int(c) * TOKEN) for i, kk, t, c in rows if kk == k]
            want.update(plain_bucket(mine, 12 * TOKEN, refill_units(rate)))
        assert got.keys() == want.keys()
        assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-6 for i in want)


def test_keys_without_a_limit_are_admitted(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 0.0) for i in range(8)], "id bigint, k string, ts double")
    limits = spark.createDataFrame([("a", 1.0, 1.0)], "k string, capacity double, refill double")
    got = token_bucket_admit(df, "k", "ts", "id", limits=limits).groupBy("k").agg(F.count_if("admitted").alias("n"))
    assert {r.k: r.n for r in got.collect()} == {"a": 1, "b": 4}


def test_clamps_bracket_the_level():
    rng = random.Random(5)
    for case in range(300):
        cap = rng.choice([3, 10, 60, 500])
        costs = rng.choice([[1], [1, 2, 5], [7, 30], [0, 1, 600], [cap]])
        steps = [(rng.choice([0, 0, 1, 2, rng.randint(0, cap)]), rng.choice(costs)) for _ in range(rng.randint(0, 80))]
        low, high = B.Clamp(cap, False), B.Clamp(cap, True)
        for g, c in steps:
            low.add(g, c)
            high.add(g, c)
        for level in range(cap + 1):
            true = plain_level(level, steps, cap)
            assert B.clamped(low.values(), level) <= true <= B.clamped(high.values(), level), (case, level)


def test_brackets_are_tight_around_whole_costs():
    """A large bucket is bracketed exactly until it is empty, then within the highest cost: the function has few pieces."""
    rng = random.Random(6)
    cap, lo, hi = 10**6 * TOKEN, 10**6 * TOKEN, 10**6 * TOKEN
    widths, most = [], 0
    for chunk in range(30):
        steps = [(rng.randint(0, 4_000_000) * 500_000, rng.randint(1, 10) * TOKEN) for _ in range(10_000)]
        clamps, stretch = (B.Clamp(cap, False), B.Clamp(cap, True)), Stretch(cap, lo, hi)
        for g, c in steps:
            clamps[0].add(g, c)
            clamps[1].add(g, c)
            stretch.add(g, c)
        most = max(most, len(stretch.pieces()))
        lo, hi = B.clamped(clamps[0].values(), lo), B.clamped(clamps[1].values(), hi)
        widths.append(hi - lo)
    assert widths[0] == 0 and 0 < widths[-1] <= 11 * TOKEN and most <= 200


@pytest.mark.parametrize("capacity,cost,refill", [(1000, "tenths", 3.0), (1_000_000, "whole", 1.0), (10, "random", 4.9)])
def test_a_million_requests_of_one_key(spark, capacity, cost, refill):
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    price = {"whole": h % 10 + 1, "tenths": (h % 100 + 1) / 10, "random": F.round(h / 100_000 + 0.001, 6)}[cost]
    df = spark.range(1_000_000).select("id", F.lit("one").alias("k"), F.timestamp_micros(F.col("id") * 900_000 + h % 800_000).alias("ts"), price.cast("double").alias("c"))
    got = {r.id: r.admitted for r in token_bucket_admit(df, "k", "ts", "id", capacity, refill, cost=F.col("c")).select("id", "admitted").toLocalIterator()}
    level = cap = capacity * TOKEN
    rate, last, want = refill_units(refill), None, {}
    for r in df.select("id", F.unix_micros("ts").alias("t"), F.round(F.col("c") * TOKEN).cast("bigint").alias("c")).toPandas().sort_values(["t", "id"]).itertuples():
        level = min(cap, level + (r.t - last) * rate) if last is not None else cap
        last, want[r.id] = r.t, level >= r.c
        level -= r.c if level >= r.c else 0
    assert got == want and 0 < sum(want.values()) < len(want)


def test_chunks_with_too_many_pieces_wait_for_their_level(spark, monkeypatch):
    monkeypatch.setattr(B, "MAX_PIECES", 3)
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "hot", "warm", "k"]), rng.randint(0, 400_000_000), round(rng.random() * 5, 6)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, k string, us bigint, c double").withColumn("ts", F.timestamp_micros("us"))
    for capacity, rate in ((6, 2.0), (50, 1.0)):
        got = {r.id: r.admitted for r in token_bucket_admit(df.repartition(16), "k", "ts", "id", capacity, rate, cost=F.col("c")).collect()}
        want = {}
        for k in ("hot", "warm", "k"):
            want |= {i: a for i, (a, _) in plain_bucket([(t, i, round(c * TOKEN)) for i, kk, t, c in rows if kk == k], capacity * TOKEN, refill_units(rate)).items()}
        assert got == want

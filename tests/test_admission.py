import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators.admission import fixed_window_admit, replay_cache
from pairloom.operators.ordered import neighbours, ranked, sorted_chunks
from pairloom.operators.carried import (
    SharedAndOwn, SlidingWindow, cross, hierarchical_admit, sliding_window_admit,
)
from pairloom.operators.bucket import TOKEN, token_bucket_admit

TIMES = [0, 0, 0, 0, 1, 2, 2.5, 10, 10, 10, 10]


def frame(spark, times):
    return spark.createDataFrame([(i, "a", float(t)) for i, t in enumerate(times)], "id bigint, k string, ts double")


def decisions(df):
    return [None if r.admitted else r.retry_after for r in df.orderBy("id").collect()]


@pytest.fixture(scope="module")
def traffic(spark):
    rng = random.Random(11)
    rows = []
    for i in range(4000):
        k = "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 30)}"
        rows.append((i, k, rng.randint(0, 3_000_000_000) // 1000 * 1000, rng.choice([1, 1, 2, 5]), rng.choice("ab")))
    df = spark.createDataFrame(rows, "id bigint, k string, us bigint, c bigint, p string")
    return rows, df.withColumn("ts", F.timestamp_micros("us")).repartition(16).drop("us")


def by_key(rows):
    out = defaultdict(list)
    for i, k, t, c, p in rows:
        out[k].append((t, i, c, p))
    return {k: sorted(v) for k, v in out.items()}


def test_golden_windows(spark):
    df = frame(spark, TIMES)
    want = [None, None, 5.0, 5.0, 4.0, 3.0, 2.5, None, None, 5.0, 5.0]
    assert decisions(fixed_window_admit(df, "k", "ts", "id", 2, 5)) == want
    assert decisions(fixed_window_admit(df, "k", "ts", "id", 2, 5, cost=F.lit(1))) == want
    assert decisions(sliding_window_admit(df, "k", "ts", "id", 2, 5)) == want
    apart = frame(spark, [4, 4, 6, 6])
    assert decisions(fixed_window_admit(apart, "k", "ts", "id", 2, 5)) == [None] * 4
    assert decisions(sliding_window_admit(apart, "k", "ts", "id", 2, 5)) == [None, None, 3.0, 3.0]


def test_weighted_fixed_window_equals_plain_loop(traffic):
    rows, df = traffic
    got = {r.id: r.admitted for r in fixed_window_admit(df, "k", "ts", "id", 20, 60, cost=F.col("c")).collect()}
    want = {}
    for k, mine in by_key(rows).items():
        used = defaultdict(int)
        for t, i, c, _ in mine:
            w = t // 60_000_000
            want[i] = used[w] + c <= 20
            used[w] += c if want[i] else 0
    assert got == want


@pytest.mark.parametrize("limit,seconds", [(5, 1.0), (10, 20.0), (3, 0.001), (40, 60.0)])
def test_sliding_equals_plain_loop(traffic, limit, seconds):
    rows, df = traffic
    got = {r.id: (r.admitted, r.retry_after) for r in
           sliding_window_admit(df, "k", "ts", "id", limit, seconds, cost=F.col("c")).collect()}
    want = {}
    limiter = SlidingWindow(limit, round(seconds * 1e6))
    for mine in by_key(rows).values():
        state = limiter.start()
        for t, i, c, _ in mine:
            admitted, wait = limiter.step(state, t, (c,))
            want[i] = (admitted, wait / 1e6)
    assert got == want


@pytest.mark.parametrize("shared,limits", [
    ((10.0, 2.0), {"a": (5.0, 1.0)}), ((3.0, 20.0), {"a": (2.0, 10.0), "b": (1.0, 5.0)}), ((6.0, 0.1), {}),
])
def test_hierarchical_equals_plain_loop(traffic, shared, limits):
    rows, df = traffic
    got = {r.id: (r.admitted, r.refused_by, round(r.retry_after, 6)) for r in
           hierarchical_admit(df, "k", "p", "ts", "id", shared, limits, cost=F.col("c")).collect()}
    units = lambda v: (round(v[0] * TOKEN), round(v[1] * 10**6))
    want = {}
    limiter = SharedAndOwn(units(shared), {n: units(v) for n, v in limits.items()})
    for mine in by_key(rows).values():
        state = {}
        for t, i, c, p in mine:
            admitted, by, wait = limiter.step(state, t, (p, c * TOKEN))
            want[i] = (admitted, by, round(wait / 1e6, 6))
    assert got == want


def test_windows_below_the_limit_need_no_past():
    """Whatever the entry state, the stretch that is called free leads to the same state; light and even load has one."""
    rng = random.Random(12)
    found = 0
    for case in range(300):
        limiter = SlidingWindow(rng.choice([2, 5, 12]), rng.choice([7, 40]))
        t = np.sort(np.array([rng.randint(0, 400) for _ in range(rng.randint(1, 120))]))
        kinds = [(rng.choice([0, 1, 1, 2, 50]),) for _ in t]
        free = limiter.last_free_row(t, kinds)
        if free < 0:
            continue
        found += 1
        fresh = limiter.start()
        for now, kind in zip(t[free:].tolist(), kinds[free:]):
            limiter.step(fresh, now, kind)
        for _ in range(4):
            warm = limiter.start()
            for now in sorted(int(t[0]) - rng.randint(0, 40) for _ in range(20)):
                limiter.step(warm, now, (rng.choice([1, 2]),))
            for now, kind in zip(t.tolist(), kinds):
                limiter.step(warm, now, kind)
            end = int(t[-1])
            assert [e for e in warm["live"] if e[0] > end - limiter.window] == [e for e in fresh["live"] if e[0] > end - limiter.window], case
    assert found > 60
    even = np.arange(0, 1000, 10)  # ten in a window of a hundred: just what is allowed
    assert SlidingWindow(10, 100).last_free_row(even, [(1,)] * 100) == 90 and SlidingWindow(9, 100).last_free_row(even, [(1,)] * 100) == -1


def test_crossing_equals_stepping():
    rng = random.Random(2)
    for case in range(200):
        if case % 2:
            limiter = SlidingWindow(rng.choice([1, 3, 10]), rng.choice([5, 50, 500]))
            kinds = [(c,) for c in rng.sample([1, 2, 4, 20], 3)]
        else:
            limiter = SharedAndOwn((rng.choice([5, 20]), rng.choice([0, 1, 3])), {"a": (4, 1), "b": (6, rng.choice([0, 2]))})
            kinds = [(p, c) for p in "abz" for c in (1, 3, 30)]
        t = np.sort(np.array([rng.randint(0, 300) for _ in range(rng.randint(1, 150))]))
        codes = np.array([rng.randrange(len(kinds)) for _ in t], dtype=np.int32)
        warm = limiter.start()
        for now in range(-20, 0):
            limiter.step(warm, now, rng.choice(kinds))
        stepped, crossed = limiter.load(limiter.dump(warm)), limiter.load(limiter.dump(warm))
        for now, code in zip(t.tolist(), codes.tolist()):
            limiter.step(stepped, now, kinds[code])
        half = len(t) // 2
        for part in (slice(0, half), slice(half, None)):
            if len(t[part]):
                cross(limiter, crossed, t[part], codes[part], kinds)
        # probe both states: they must decide alike from here on
        for now in range(int(t[-1]), int(t[-1]) + 600, 7):
            kind = rng.choice(kinds)
            assert limiter.step(stepped, now, kind) == limiter.step(crossed, now, kind), case


def test_replay_golden(spark):
    got = replay_cache(frame(spark, [0, 4, 10, 11, 20, 21, 22]), "k", "ts", "id", 10).orderBy("id").collect()
    assert [r.hit for r in got] == [False, True, True, False, True, True, False]


@pytest.mark.parametrize("ttl", [0.002, 1.0, 30.0, 4000.0])
def test_replay_equals_plain_loop(traffic, ttl):
    rows, df = traffic
    got = {r.id: r.hit for r in replay_cache(df, "k", "ts", "id", ttl).collect()}
    want = {}
    for k, mine in by_key(rows).items():
        dies = None
        for t, i, _, _ in mine:
            want[i] = dies is not None and t <= dies
            if not want[i]:
                dies = t + round(ttl * 1e6)
    assert got == want


def test_ranked_and_neighbour(spark, traffic):
    rows, df = traffic
    got = {r.id: r.rn for r in ranked(df, ["k"], ["ts", "id"]).collect()}
    assert got == {v[1]: n + 1 for mine in by_key(rows).values() for n, v in enumerate(mine)}
    whole = [r.rn for r in ranked(df, [], ["ts", "id"]).orderBy("ts", "id").collect()]
    assert whole == list(range(1, len(rows) + 1))
    ch = sorted_chunks(df, ["k"], ["ts", "id"])
    assert ch.where("k = 'hot'").select("chunk").distinct().count() >= 4
    odd = F.when(F.col("c") == 5, F.col("id"))
    found = neighbours(ch, ["k"], ["ts", "id"], odd).collect()
    for following in (False, True):
        got = {r.id: r.next if following else r.prev for r in found}
        want = {}
        for mine in by_key(rows).values():
            last = None
            for t, i, c, _ in reversed(mine) if following else mine:
                want[i] = last
                last = i if c == 5 else last
        assert got == want


def test_null_keys_are_one_key(spark, traffic):
    rows, df = traffic
    nulls = df.withColumn("k", F.nullif("k", F.lit("hot")))
    for admit in (
        lambda d: token_bucket_admit(d, "k", "ts", "id", 5, 0.5),
        lambda d: sliding_window_admit(d, "k", "ts", "id", 5, 20),
        lambda d: hierarchical_admit(d, "k", "p", "ts", "id", (4, 0.1), {"a": (1, 0.01)}),
        lambda d: fixed_window_admit(d, "k", "ts", "id", 5, 500),
        lambda d: fixed_window_admit(d, "k", "ts", "id", 5, 500, cost=F.col("c")),
        lambda d: replay_cache(d, "k", "ts", "id", 30).withColumnRenamed("hit", "admitted"),
    ):
        a, b = ({r.id: (r.k, r.admitted) for r in admit(d).collect()} for d in (df, nulls))
        assert {i: (None if k == "hot" else k, v) for i, (k, v) in a.items()} == b

"""Token-bucket admission, exact and parallel inside a key.

A bucket is an ordered fold: each request sees the level that the previous ones
left. Levels are whole numbers (10^-12 tokens), so sums are exact and a stretch
of requests is a piecewise function *level in -> level out* whose pieces either
shift the level or set it. That function is not monotone (a level that can pay leaves
less than one that cannot), but it lies between two that are, and these are
clamps: three numbers, whatever the length of the stretch.

1. The requests are range-partitioned on (key, time, id); a busy key spreads
   over many chunks.
2. Each chunk computes the two clamps of the key it may continue (in parallel). From the full bucket at
   the key's first request they bracket the level at every chunk border: exactly until requests are
   refused, then within about the highest cost, exactly again once the bucket has filled up.
3. Chunks between which the bracket is open compute the exact function, on the levels
   in the bracket only (in parallel). It has few pieces for costs with few digits; beyond ``MAX_PIECES``, which
   random fractions can reach in a long chunk without a full bucket, the chunk waits for its entry level and is folded from it.
4. Functions are applied one after the other: one row per chunk.
5. Each chunk, now knowing its starting level, decides its own requests.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ordered import key_back, key_text, micros, sorted_chunks, with_carried
from pairloom.session import cut

TOKEN = 10**12  # level units per token
REFILL = 10**6  # level units per microsecond, for a refill of one token per second
UNLIMITED = -1

MAX_PIECES = 20_000  # of a chunk's function; some hundred kilobytes

# Of each key that a chunk may continue, and of the last one that begins in it: ``left`` is the level after the chunk if the
# key begins with it; the clamps are (lowest, highest, shift) of the lower and of the upper bound.
BOUNDS = (
    "k string, chunk int, first_t bigint, last_t bigint, cap bigint, rate bigint, left bigint, "
    "low array<bigint>, high array<bigint>"
)
OPEN = "k string, chunk int, lo bigint, hi bigint"
FUNCTIONS = "k string, chunk int, los array<bigint>, shifts array<boolean>, vals array<bigint>"
STARTS = "k string, chunk int, start_level bigint, start_t bigint, waits boolean"
DECIDED = "k string, t bigint, id bigint, cost bigint, admitted boolean, retry_us double, level bigint"


def level_units(tokens: float) -> int:
    return round(Fraction(str(tokens)) * TOKEN)


def refill_units(tokens_per_second: float) -> int:
    units = Fraction(str(tokens_per_second)) * REFILL
    if units.denominator != 1:
        raise ValueError("refill rates have a resolution of 10^-6 tokens per second")
    return int(units)


# A piece is (lo, hi, shift?, v): levels lo..hi map to level + v, or all to v.


def _append(out: list, lo: int, hi: int, shift: bool, v: int) -> None:
    if out and out[-1][2] == shift and out[-1][3] == v and out[-1][1] + 1 == lo:
        out[-1] = (out[-1][0], hi, shift, v)
    else:
        out.append((lo, hi, shift, v))


def _advance(pieces: list, gain: int, cost: int, cap: int) -> list:
    """The pieces after a refill of ``gain`` and a request of ``cost``."""
    out: list = []
    for lo, hi, shift, v in pieces:
        if not shift:
            level = min(cap, v + gain)
            _append(out, lo, hi, False, level - cost if level >= cost else level)
            continue
        v += gain
        full = cap - v  # levels from here on fill the bucket
        if full <= hi:
            top = max(lo, full)
            rest = cap - cost if cap >= cost else cap
            enough = min(max(cost - v, lo), top)
            if enough > lo:
                _append(out, lo, enough - 1, True, v)
            if enough < top:
                _append(out, enough, top - 1, True, v - cost)
            _append(out, top, hi, False, rest)
            continue
        enough = cost - v  # levels from here on pay for the request
        if enough <= lo:
            _append(out, lo, hi, True, v - cost)
        elif enough > hi:
            _append(out, lo, hi, True, v)
        else:
            _append(out, lo, enough - 1, True, v)
            _append(out, enough, hi, True, v - cost)
    return out


def _then(first: list, second: list) -> list:
    """Pieces of ``second`` applied after ``first``."""
    los = [p[0] for p in second]
    out: list = []
    for lo, hi, shift, v in first:
        if not shift:
            _, _, s2, v2 = second[bisect_right(los, v) - 1]
            _append(out, lo, hi, False, v + v2 if s2 else v2)
            continue
        at = lo
        i = bisect_right(los, lo + v) - 1
        while at <= hi:
            _, hi2, s2, v2 = second[i]
            end = min(hi, hi2 - v)
            if s2:
                _append(out, at, end, True, v + v2)
            else:
                _append(out, at, end, False, v2)
            at, i = end + 1, i + 1
    return out


def _reached(pieces: list) -> list:
    """The identity on the levels that the pieces can produce."""
    spans = sorted((lo + v, hi + v) if shift else (v, v) for lo, hi, shift, v in pieces)
    out: list = []
    for a, b in spans:
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b), True, 0)
        else:
            out.append((a, b, True, 0))
    return out


class Stretch:
    """Level function, on the levels ``lo`` to ``hi``, of the requests added so far.

    Only the levels that can still occur are tracked (``local``); the function
    back to the starting levels is composed when ``local`` has grown, which it may do to the root of what it is composed with.
    """

    def __init__(self, cap: int, lo: int = 0, hi: int | None = None, most: int | None = None):
        self.cap, self.most = cap, most
        self.total = [(lo, cap if hi is None else hi, True, 0)]
        self.local = list(self.total)
        self.limit = 8

    def add(self, gain: int, cost: int) -> None:
        if not self.local:
            return
        self.local = _advance(self.local, gain, cost, self.cap)
        if len(self.local) > self.limit:
            self._fold()

    def _fold(self) -> None:
        if not self.local:
            return
        self.total = _then(self.total, self.local)
        self.local = _reached(self.local)
        self.limit = max(8, 2 * len(self.local), isqrt(len(self.total)))
        if self.most is not None and len(self.total) > self.most:
            self.total, self.local = [], []  # given up

    def pieces(self) -> list:
        self._fold()
        return self.total


class Clamp:
    """max(lowest, min(highest, level + shift)): a bound of the level after the requests added so far.

    The lower bound charges every request, as far as the level goes. The upper one knows that a refused
    request costs more than the level there was. Requests above the capacity change nothing.
    """

    def __init__(self, cap: int, upper: bool):
        self.cap, self.upper = cap, upper
        self.lowest, self.highest, self.shift = 0, cap, 0

    def add(self, gain: int, cost: int) -> None:
        cap, shift = self.cap, self.shift + gain
        low, high = min(cap, self.lowest + gain), min(cap, self.highest + gain)
        if cost <= cap:
            floor = cost - 1 if self.upper and cost > 0 else 0
            low, high, shift = max(floor, low - cost), max(floor, high - cost), shift - cost
        # beyond these the shift makes no difference, and stays a number of 64 bits
        self.lowest, self.highest, self.shift = low, high, max(low - cap, min(high, shift))

    def values(self) -> list[int]:
        return [self.lowest, self.highest, self.shift]


def clamped(clamp, level: int) -> int:
    lowest, highest, shift = (int(x) for x in clamp)
    return max(lowest, min(highest, level + shift))


def _refilled(level: int, elapsed: int, cap: int, rate: int) -> int:
    if rate and elapsed > cap // rate:
        return cap
    return min(cap, level + elapsed * rate)


def bound_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bounds of the first key of a chunk, and the level that its last key leaves, see ``BOUNDS``."""
    first = clamps = key = begin = level = last_t = None
    out = []

    def done() -> tuple:
        low, high = (c.values() for c in clamps) if clamps else (None, None)
        return (*begin[:3], last_t, *begin[3:], level, low, high)

    for pdf in batches:
        rows = zip(pdf.k, pdf.chunk.tolist(), pdf.t.tolist(), pdf.cost.tolist(), pdf.cap.tolist(), pdf.rate.tolist())
        for k, chunk, t, cost, cap, rate in rows:
            if k != key:
                if key is not None and key == first:
                    out.append(done())
                if first is None:
                    first = k
                    clamps = (Clamp(cap, False), Clamp(cap, True)) if cap != UNLIMITED else None
                else:
                    clamps = None
                key, begin, level, last_t = k, (k, chunk, t, cap, rate), max(cap, 0), t
            if cap != UNLIMITED:
                elapsed = t - last_t
                gain = cap if rate and elapsed > cap // rate else elapsed * rate
                level = min(cap, level + gain)
                if level >= cost:
                    level -= cost
                if clamps:
                    clamps[0].add(gain, cost)
                    clamps[1].add(gain, cost)
            last_t = t
    if key is not None:
        out.append(done())
    yield pd.DataFrame(out, columns=[c.split()[0] for c in BOUNDS.split(", ")])


def open_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    """The chunks of a key whose last level does not follow from bounds, with the levels that they can be entered with."""
    out, lo, hi, last_t = [], None, None, None
    for r in pdf.sort_values("chunk").itertuples():
        cap, rate = int(r.cap), int(r.rate)
        if cap == UNLIMITED:
            break
        if lo is None:
            lo = hi = int(r.left)
        else:
            elapsed = int(r.first_t) - last_t
            lo, hi = _refilled(lo, elapsed, cap, rate), _refilled(hi, elapsed, cap, rate)
            below, above = clamped(r.low, lo), clamped(r.high, hi)
            if below < above:
                out.append((r.k, r.chunk, lo, hi))
            lo, hi = below, above
        last_t = int(r.last_t)
    return pd.DataFrame(out, columns=["k", "chunk", "lo", "hi"])


def describe_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact functions of open chunks; without pieces where there would be too many."""
    at = stretch = last_t = None
    out = []

    def done() -> tuple:
        pieces = stretch.pieces()
        return (*at, *([p[i] for p in pieces] if pieces else None for i in (0, 2, 3)))

    for pdf in batches:
        rows = zip(pdf.k, pdf.chunk.tolist(), pdf.t.tolist(), pdf.cost.tolist(), pdf.cap.tolist(), pdf.rate.tolist(), pdf.lo.tolist(), pdf.hi.tolist())
        for k, chunk, t, cost, cap, rate, lo, hi in rows:
            if (k, chunk) != at:
                if at is not None:
                    out.append(done())
                at, stretch, last_t = (k, chunk), Stretch(cap, lo, hi, MAX_PIECES), t
            elapsed, last_t = t - last_t, t
            stretch.add(cap if rate and elapsed > cap // rate else elapsed * rate, cost)
    if at is not None:
        out.append(done())
    yield pd.DataFrame(out, columns=[c.split()[0] for c in FUNCTIONS.split(", ")])


def starting_levels(pdf: pd.DataFrame) -> pd.DataFrame:
    """Level and time with which a key enters each of its later chunks.

    A chunk that should have a function and has none gets its level and ``waits``; what comes after it has to wait too.
    """
    out, level, lo, hi, last_t = [], None, None, None, None
    for r in pdf.sort_values("chunk").itertuples():
        cap, rate = int(r.cap), int(r.rate)
        if cap == UNLIMITED:
            break
        if level is None:
            level = int(r.left)
        else:
            entry = _refilled(level, int(r.first_t) - last_t, cap, rate)
            if r.open and r.los is None:
                out.append((r.k, r.chunk, level, last_t, True))
                break
            out.append((r.k, r.chunk, level, last_t, False))
            if r.open:
                i = bisect_right([int(x) for x in r.los], entry) - 1
                level = entry + int(r.vals[i]) if r.shifts[i] else int(r.vals[i])
            else:
                level = clamped(r.low, entry)
        last_t = int(r.last_t)
    return pd.DataFrame(out, columns=[c.split()[0] for c in STARTS.split(", ")])


def left_levels(decided: DataFrame) -> DataFrame:
    """What a chunk that was decided on its own leaves, as a function that sets the level."""
    last = decided.groupBy("k", "chunk").agg(F.max_by("level", "idx").alias("level"))
    return last.select("k", "chunk", F.array(F.lit(0).cast("bigint")).alias("los"), F.array(F.lit(False)).alias("shifts"), F.array("level").alias("vals"))


def decide_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Admission of each request, given the level at the start of the chunk."""
    key = level = last_t = None
    for pdf in batches:
        admitted, retry, levels = [], [], []
        rows = zip(
            pdf.k,
            pdf.t.tolist(),
            pdf.cost.tolist(),
            pdf.cap.tolist(),
            pdf.rate.tolist(),
            pdf.start_level.tolist(),
            pdf.start_t.tolist(),
        )
        for k, t, cost, cap, rate, start_level, start_t in rows:
            if cap == UNLIMITED:
                key = k
                admitted.append(True)
                retry.append(0.0)
                levels.append(UNLIMITED)
                continue
            if k != key:
                key = k
                level, last_t = (start_level, start_t) if start_level >= 0 else (cap, t)
            level = _refilled(level, t - last_t, cap, rate)
            last_t = t
            if level >= cost:
                level -= cost
                admitted.append(True)
                retry.append(0.0)
            else:
                admitted.append(False)
                retry.append((cost - level) / rate if rate else None)
            levels.append(level)
        yield pd.DataFrame(
            {
                "k": pdf.k,
                "t": pdf.t,
                "id": pdf.id,
                "cost": pdf.cost,
                "admitted": admitted,
                "retry_us": pd.Series(retry, dtype="float64"),
                "level": pd.Series(levels, dtype="int64"),
                **{c: pdf[c] for c in ("chunk", "idx") if c in pdf},
            }
        )


def entry_levels(chunks: DataFrame) -> DataFrame:
    """``STARTS`` for the keys that continue into a chunk: at most one row a chunk."""
    narrow = chunks.select("k", "chunk", "t", "cost", "cap", "rate")
    bounds = cut(narrow.mapInPandas(bound_chunk, BOUNDS))
    unsure = cut(bounds.groupBy("k").applyInPandas(open_chunks, OPEN))
    marked = bounds.join(unsure.select("k", "chunk", F.lit(True).alias("open")), ["k", "chunk"], "left").fillna({"open": False})

    def walk(functions: DataFrame) -> DataFrame:
        return marked.join(functions, ["k", "chunk"], "left").groupBy("k").applyInPandas(starting_levels, STARTS)

    inside = with_carried(narrow, unsure, ["k"]).where(F.col("lo").isNotNull())
    functions = cut(inside.mapInPandas(describe_chunk, FUNCTIONS))
    if functions.where(F.col("los").isNull()).isEmpty():
        return walk(functions)
    functions = functions.where(F.col("los").isNotNull())
    while True:
        starts = cut(walk(functions))
        waiting = starts.where("waits")
        if waiting.isEmpty():
            return starts
        # one chunk a key and round: the next one needs what this one leaves
        rows = with_carried(chunks, waiting, ["k"]).where(F.col("start_level").isNotNull())
        decided = rows.select("k", "t", "id", "cost", "cap", "rate", "start_level", "start_t", "chunk", "idx").mapInPandas(decide_chunk, DECIDED + ", chunk int, idx bigint")
        functions = cut(functions.unionByName(left_levels(decided)))


def admit_by_bucket(requests: DataFrame) -> DataFrame:
    """Decisions for rows (k, t, id, cost, cap, rate), see ``DECIDED``.

    ``cap`` and ``rate`` are in level units and constant per key; cap -1 means
    that the key has no limit.
    """
    chunks = sorted_chunks(requests.select("k", "t", "id", "cost", "cap", "rate"), ["k"], ["t", "id"])
    return (
        with_carried(chunks, entry_levels(chunks).drop("waits"), ["k"])
        .select(
            "k", "t", "id", "cost", "cap", "rate",
            F.coalesce("start_level", F.lit(-1)).alias("start_level"),
            F.coalesce("start_t", F.lit(0)).alias("start_t"),
        )
        .mapInPandas(decide_chunk, DECIDED)
    )


def exact(value: Column, unit: int) -> Column:
    """``value`` in whole units; raises where rounding would change it, as 3e-7 would become 0."""
    units = F.round(value * unit)
    off = F.abs(units - value * unit) > 1e-6 * F.greatest(F.lit(1.0), F.abs(units))
    return F.when(off, F.raise_error(F.concat(F.lit("refill is finer than a unit: "), value.cast("string"))).cast("double")).otherwise(units).cast("bigint")


def token_bucket_admit(
    requests: DataFrame,
    key: str,
    ts: str,
    tie: str,
    capacity: float | None = None,
    refill: float | None = None,
    limits: DataFrame | None = None,
    cost: Column | None = None,
) -> DataFrame:
    """Admit requests per key while tokens last.

    One ``capacity``/``refill`` (tokens per second) for all keys, or ``limits``
    (key, capacity, refill) for some of them: keys without a limit are always
    admitted. Buckets start full. Returns (key, ts_us, tie, cost, admitted,
    retry_after): ``retry_after`` is in seconds, 0 when admitted. Only these
    narrow columns are shuffled; join on (key, tie) for more.
    """
    price = F.lit(TOKEN).cast("bigint") if cost is None else F.round(cost * TOKEN).cast("bigint")
    rows = requests.select(
        key_text(key), micros(requests, ts).alias("t"), F.col(tie).alias("id"), price.alias("cost")
    )
    if limits is None:
        rows = rows.withColumn("cap", F.lit(level_units(capacity)).cast("bigint"))
        rows = rows.withColumn("rate", F.lit(refill_units(refill)).cast("bigint"))
    else:
        dim = limits.select(
            key_text(key),
            F.round(F.col("capacity") * TOKEN).cast("bigint").alias("cap"),
            exact(F.col("refill"), REFILL).alias("rate"),
        )
        rows = rows.join(dim, "k", "left").fillna({"cap": UNLIMITED, "rate": 0})
    decided = admit_by_bucket(rows)
    return decided.select(
        key_back(requests, key),
        F.col("t").alias("ts_us"),
        F.col("id").alias(tie),
        (F.col("cost") / F.lit(float(TOKEN))).alias("cost"),
        "admitted",
        (F.col("retry_us") / 1e6).alias("retry_after"),
    )

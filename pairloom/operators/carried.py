"""Ordered admission whose state is more than one number.

A sliding window remembers its last admissions, a shared bucket above provider
buckets several levels. The rows are range-partitioned on (key, time, id) and
every chunk is decided on its own, once the state in which it is entered is
known. Per chunk and continuing key:

1. In parallel, each chunk looks for the last row at which the state is the same
   whatever came before, and folds from there to the state at its end. A chunk
   without such a row is under overload throughout; it hands on its times and
   request classes as packed numbers.
2. A walk over the chunks of a key, in order, gives each its entry state. An
   overloaded chunk is crossed in jumps from one admission to the next, so the
   work is bounded by what the limits admit, not by the requests.
3. In parallel, each chunk decides its requests from its entry state.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.bucket import TOKEN, level_units, refill_units
from pairloom.operators.ordered import NO_KEY, key_back, key_text, micros, sorted_chunks, whole

SUMMARY = "k string, chunk int, piece int, state string, times binary, codes binary, classes string"
ENTRIES = "k string, chunk int, state string"
PIECE = 2048  # requests per packed row, so that a batch of rows stays small
BROADCAST_BYTES = 64 << 20

# A request is (time, class): the class says what it needs, e.g. its cost.


class SlidingWindow:
    """State: admitted (time, cost) inside the window, oldest first."""

    columns = ("cost",)
    decision = "admitted boolean, retry_us double"

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def start(self) -> dict:
        return {"live": deque(), "used": 0}

    def dump(self, state: dict) -> str:
        return json.dumps([list(e) for e in state["live"]])

    def load(self, text: str) -> dict:
        live = deque(tuple(e) for e in json.loads(text))
        return {"live": live, "used": sum(c for _, c in live)}

    def state_bytes(self) -> int:
        return 32 * max(self.limit, 1)

    def step(self, state: dict, t: int, cls: tuple) -> tuple:
        (cost,), live = cls, state["live"]
        while live and live[0][0] <= t - self.window:
            state["used"] -= live.popleft()[1]
        if state["used"] + cost <= self.limit:
            self.admit(state, t, cls)
            return True, 0.0
        return False, float(live[0][0] + self.window - t) if live else 0.0

    def admit(self, state: dict, t: int, cls: tuple) -> None:
        live = state["live"]
        while live and live[0][0] <= t - self.window:
            state["used"] -= live.popleft()[1]
        if cls[0]:
            live.append((t, cls[0]))
            state["used"] += cls[0]

    def ready(self, state: dict, cls: tuple) -> int | None:
        """Time from which the class is admitted if nothing else is before it."""
        if cls[0] > self.limit:
            return None
        used, at = state["used"], 0
        for t, c in state["live"]:
            if used + cls[0] <= self.limit:
                break
            used, at = used - c, t + self.window
        return at

    def last_free_row(self, t: np.ndarray, classes: list[tuple]) -> int:
        """Start of the last stretch that the past cannot influence, or -1.

        A request finds room, whatever came before, if all requests of the window up to it fit into the limit. If that
        holds for every request of a window, all of them were admitted and nothing else counts; folding can start
        with the first of them. It needs no more than the limit in any one window, so a chunk is without such a
        stretch only if requests may be refused throughout.
        """
        costs = np.array([c[0] if c[0] <= self.limit else 0 for c in classes])  # above the limit nothing is ever admitted
        begin = np.searchsorted(t, t - self.window, side="right")
        total = np.concatenate([[0], np.cumsum(costs)])
        tight = (total[1:] - total[begin] > self.limit) | (t - self.window < t[0])
        tights = np.concatenate([[0], np.cumsum(tight)])
        free = np.flatnonzero(tights[1:] == tights[begin])
        return int(begin[free[-1]]) if len(free) else -1


class SharedAndOwn:
    """One shared bucket, then the provider's own. State: {name: [level, time]};
    "" is the shared bucket. A refusal takes nothing."""

    columns = ("provider", "cost")
    decision = "admitted boolean, refused_by string, retry_us double"

    def __init__(self, shared: tuple[int, int], limits: Mapping[str, tuple[int, int]]):
        self.buckets = {"": shared, **{"p:" + p: v for p, v in limits.items()}}

    def start(self) -> dict:
        return {}

    dump, load = staticmethod(json.dumps), staticmethod(json.loads)

    def state_bytes(self) -> int:
        return 64 * len(self.buckets)

    def met(self, cls: tuple) -> list[str]:
        own = "p:" + cls[0]
        return ["", own] if own in self.buckets else [""]

    def level(self, state: dict, name: str, t: int) -> int:
        cap, rate = self.buckets[name]
        level, at = state.get(name, (cap, t))
        return min(cap, level + (t - at) * rate)

    def step(self, state: dict, t: int, cls: tuple) -> tuple:
        for name in self.met(cls):
            short = cls[1] - self.level(state, name, t)
            if short > 0:
                rate = self.buckets[name][1]
                return False, "provider" if name else "shared", short / rate if rate else None
        self.admit(state, t, cls)
        return True, None, 0.0

    def admit(self, state: dict, t: int, cls: tuple) -> None:
        for name in self.met(cls):
            state[name] = [self.level(state, name, t) - cls[1], t]

    def ready(self, state: dict, cls: tuple) -> int | None:
        at = 0
        for name in self.met(cls):
            cap, rate = self.buckets[name]
            level, since = state.get(name, (cap, 0))
            if cls[1] > cap or (level < cls[1] and not rate):
                return None
            if level < cls[1]:
                at = max(at, since + -(-(cls[1] - level) // rate))
        return at

    def last_free_row(self, t: np.ndarray, classes: list[tuple]) -> int:
        """Last row at which all buckets are surely full, or -1.

        Charging every request, down to an empty bucket, gives a level that the
        true one is never below.
        """
        floor = {name: (0, int(t[0])) for name in self.buckets}
        last = -1
        for i, (now, cls) in enumerate(zip(t.tolist(), classes)):
            if all(lv + (now - at) * self.buckets[n][1] >= self.buckets[n][0] for n, (lv, at) in floor.items()):
                last = i
            for name in self.met(cls):
                cap, rate = self.buckets[name]
                level, at = floor[name]
                floor[name] = (max(0, min(cap, level + (now - at) * rate) - cls[1]), now)
        return last


def cross(limiter, state: dict, t: np.ndarray, codes: np.ndarray, classes: list[tuple]) -> None:
    """Advance the state over requests, going from admission to admission."""
    places = {c: np.flatnonzero(codes == c) for c in np.unique(codes).tolist()}
    at = 0
    while at < len(t):
        nearest = None
        for code, where in places.items():
            ready = limiter.ready(state, classes[code])
            if ready is None or ready > t[-1]:
                continue
            i = np.searchsorted(where, max(at, int(np.searchsorted(t, ready, side="left"))))
            if i < len(where) and (nearest is None or where[i] < nearest[0]):
                nearest = (int(where[i]), code)
        if nearest is None:
            return
        limiter.admit(state, int(t[nearest[0]]), classes[nearest[1]])
        at = nearest[0] + 1


def _summaries(limiter):
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, mine, key, state, chunk = None, [], None, None, None
        for pdf in batches:
            if first is None:
                first, chunk = pdf.k.iloc[0], int(pdf.chunk.iloc[0])
            head = pdf[pdf.k == first] if key is None else pdf.iloc[:0]
            if len(head):
                mine.append(head)
            rest = pdf.iloc[len(head):]
            for k, t, *cls in zip(rest.k, rest.t.tolist(), *(rest[c].tolist() for c in limiter.columns)):
                if k != key:
                    key, state = k, limiter.start()
                limiter.step(state, t, tuple(cls))
        if first is None:
            return
        out = _first_key(limiter, first, chunk, pd.concat(mine, ignore_index=True))
        if key is not None:
            out.append((key, chunk, 0, limiter.dump(state), None, None, None))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SUMMARY.split(", ")])

    return summarise


def _first_key(limiter, key: str, chunk: int, pdf: pd.DataFrame) -> list[tuple]:
    t = pdf.t.to_numpy()
    classes = list(zip(*(pdf[c].tolist() for c in limiter.columns)))
    free = 0 if chunk == 0 else limiter.last_free_row(t, classes)
    if free >= 0:
        state = limiter.start()
        for now, cls in zip(t[free:].tolist(), classes[free:]):
            limiter.step(state, now, cls)
        return [(key, chunk, 0, limiter.dump(state), None, None, None)]
    kinds = sorted(set(classes))
    number = {c: i for i, c in enumerate(kinds)}
    codes = np.array([number[c] for c in classes], dtype=np.int32)
    names = json.dumps(kinds)
    return [
        (key, chunk, i, None, t[a:a + PIECE].tobytes(), codes[a:a + PIECE].tobytes(), names)
        for i, a in enumerate(range(0, len(t), PIECE))
    ]


def _entries(limiter):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = chunk = state = None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.k != key:
                    key, chunk, state = r.k, r.chunk, limiter.start()
                elif r.chunk != chunk:
                    chunk = r.chunk
                    out.append((key, chunk, limiter.dump(state)))
                if r.state is not None:
                    state = limiter.load(r.state)
                else:
                    kinds = [tuple(c) for c in json.loads(r.classes)]
                    cross(limiter, state, np.frombuffer(r.times, np.int64), np.frombuffer(r.codes, np.int32), kinds)
            yield pd.DataFrame(out, columns=["k", "chunk", "state"])

    return walk


def _decide(limiter, names: list[str]):
    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = state = None
        for pdf in batches:
            out = []
            rows = zip(pdf.k, pdf.chunk.tolist(), pdf.state, pdf.t.tolist(), *(pdf[c].tolist() for c in limiter.columns))
            for k, chunk, entry, t, *cls in rows:
                if (k, chunk) != current:
                    current, state = (k, chunk), limiter.load(entry) if entry else limiter.start()
                out.append(limiter.step(state, t, tuple(cls)))
            made = pd.DataFrame(out, columns=names, index=pdf.index)
            yield pd.concat([pdf.drop(columns=["chunk", "idx", "state"]), made], axis=1)

    return decide


def admit_in_order(requests: DataFrame, limiter) -> DataFrame:
    """Decisions of the limiter for rows (k, t, id and its class columns)."""
    chunks = sorted_chunks(requests.select("k", "t", "id", *limiter.columns), ["k"], ["t", "id"])
    summary = chunks.mapInPandas(_summaries(limiter), SUMMARY)
    entries = (
        summary.repartition("k").sortWithinPartitions("k", "chunk", "piece").mapInPandas(_entries(limiter), ENTRIES)
    )
    # At most one entry per chunk; broadcast if the states cannot be large.
    if chunks.rdd.getNumPartitions() * limiter.state_bytes() <= BROADCAST_BYTES:
        entries = F.broadcast(entries)
    placed = (
        chunks.join(entries, ["k", "chunk"], "left")
        .select(
            "k", "t", "id", *limiter.columns, "chunk", "idx",
            # A key that continues into a chunk is its first; one row carries the state.
            F.when(F.col("idx") == 0, F.col("state")).alias("state"),
        )
        .sortWithinPartitions("k", "chunk", "idx")
    )
    kept = placed.drop("chunk", "idx", "state")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", " + limiter.decision
    names = [d.split()[0] for d in limiter.decision.split(", ")]
    return placed.mapInPandas(_decide(limiter, names), schema)


def sliding_window_admit(
    requests: DataFrame, key: str, ts: str, tie: str, limit: int, seconds: float, cost: Column | None = None
) -> DataFrame:
    """Admit while what was admitted in the last ``seconds`` plus the cost fits.

    An admission exactly ``seconds`` old no longer counts. ``retry_after`` is
    the time until the oldest counted admission leaves the window.
    """
    price = F.lit(1).cast("bigint") if cost is None else whole(cost)
    rows = requests.select(
        key_text(key), micros(requests, ts).alias("t"), F.col(tie).cast("bigint").alias("id"),
        price.alias("cost"),
    )
    decided = admit_in_order(rows, SlidingWindow(limit, round(seconds * 1_000_000)))
    return decided.select(
        key_back(requests, key), F.col("t").alias("ts_us"), F.col("id").alias(tie), "cost", "admitted",
        (F.col("retry_us") / 1e6).alias("retry_after"),
    )


def hierarchical_admit(
    requests: DataFrame,
    scope: str,
    provider: str,
    ts: str,
    tie: str,
    shared: tuple[float, float],
    limits: Mapping[str, tuple[float, float]],
    cost: Column | None = None,
) -> DataFrame:
    """Admit through one shared bucket per scope and one per provider in it.

    ``shared`` and the values of ``limits`` are (capacity, refill per second);
    a provider that is not in ``limits`` only meets the shared bucket.
    """
    limiter = SharedAndOwn(
        (level_units(shared[0]), refill_units(shared[1])),
        {p: (level_units(c), refill_units(r)) for p, (c, r) in limits.items()},
    )
    price = F.lit(TOKEN).cast("bigint") if cost is None else F.round(cost * TOKEN).cast("bigint")
    rows = requests.select(
        key_text(scope), micros(requests, ts).alias("t"), F.col(tie).cast("bigint").alias("id"),
        F.coalesce(F.col(provider), F.lit(NO_KEY)).alias("provider"), price.alias("cost"),
    )
    decided = admit_in_order(rows, limiter)
    return decided.select(
        key_back(requests, scope), F.col("t").alias("ts_us"), F.col("id").alias(tie), F.nullif("provider", F.lit(NO_KEY)).alias(provider),
        (F.col("cost") / F.lit(float(TOKEN))).alias("cost"), "admitted", "refused_by",
        (F.col("retry_us") / 1e6).alias("retry_after"),
    )

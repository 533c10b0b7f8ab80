"""Benchmark decontamination: which words of a text lie in a window of a test item.

Search is Wu-Manber's, on words instead of characters. All windows of one length are searched together. A
table tells, for the last two words under the search window, how far the window may move on without
missing an occurrence; pairs that end a test window lead to a bucket, split further by the window's first
two words, and the few test windows in it are compared word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import cut, share, slices

WINDOW = 10
# Words of test items that one pass searches for; more items mean more passes, not larger tables.
PASS_WORDS = 100_000

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TO_WORDS = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words: digits, letters and everything beyond ASCII, with A-Z lower-cased; NULL has none."""
    return text.encode().translate(_TO_WORDS).split() if text else []


class WuManber:
    """All test windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        self.default = length - self.block + 1
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            suffix, prefix = window[-self.block :], window[: self.block]
            self.buckets.setdefault(suffix, {}).setdefault(prefix, []).append((window, items))

    def occurrences(self, text: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of every occurrence, in order."""
        m, b, n = self.length, self.block, len(text)
        shift, buckets, default = self.shift.get, self.buckets, self.default
        end = m
        while end <= n:
            key = (text[end - 2], text[end - 1]) if b == 2 else (text[end - 1],)
            step = shift(key, default)
            if step:
                end += step
                continue
            start = end - m
            for window, items in buckets[key].get(tuple(text[start : start + b]), ()):
                if all(x == y for x, y in zip(window, text[start:end], strict=True)):
                    yield start, items
            end += 1


class Searcher:
    """The windows of some test items, by length."""

    def __init__(self, pieces: list[tuple[int | None, list[bytes]]]):
        by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for item, text in pieces:
            m = min(WINDOW, len(text))
            for i in range(len(text) - m + 1 if m else 0):
                items = by_length.setdefault(m, {}).setdefault(tuple(text[i : i + m]), [])
                if item not in items:
                    items.append(item)
        self.parts = [WuManber(windows, m) for m, windows in sorted(by_length.items())]

    def spans(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int | None]]:
        """Hit stretches of words (start, end), unmerged, and the items that occur."""
        spans, items = [], set()
        for part in self.parts:
            for start, found in part.occurrences(text):
                if spans and spans[-1][0] <= start <= spans[-1][1] <= start + part.length:
                    spans[-1] = (spans[-1][0], start + part.length)
                else:
                    spans.append((start, start + part.length))
                items.update(found)
        return spans, items


class Pass:
    """Test pieces as broadcast; a worker builds its tables from them once."""

    def __init__(self, pieces: list[tuple[int | None, list[bytes]]]):
        self.pieces, self.built = pieces, None

    def searcher(self) -> Searcher:
        if self.built is None:
            self.built = Searcher(self.pieces)
        return self.built


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _passes(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Test items cut into pieces that keep every window, dealt into passes of bounded size.

    A piece has at most a tenth of a pass; pieces of one item overlap by a window less a word. The driver
    streams pieces and holds one pass of them at a time.
    """
    step = PASS_WORDS // 10

    def cut_up(batches):
        for batch in batches:
            ids, pieces = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                for start in range(0, max(len(w) - WINDOW + 1, min(len(w), 1)), step):
                    ids.append(item)
                    pieces.append(b" ".join(w[start : start + step + WINDOW - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.binary())], ["item_id", "piece"])

    rows = items.select(F.col("item_id").cast("bigint"), "text").mapInArrow(cut_up, "item_id bigint, piece binary").distinct()
    batch, held = [], 0
    for row in rows.toLocalIterator():
        piece = bytes(row.piece).split()
        if held and held + len(piece) > PASS_WORDS:
            yield batch
            batch, held = [], 0
        batch.append((row.item_id, piece))
        held += len(piece)
    if batch:
        yield batch


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (hit stretches of words, merged, end excluded) and ``item_ids``.

    ``docs`` needs ``text``, ``items`` needs ``item_id`` and ``text``; every row of ``docs`` is kept and the columns in
    ``keep`` (all by default), save that columns named as the three new ones are replaced. A NULL or empty text has no words. Items
    that are NULL or without words have no windows, repeated items count once, an item without id marks words but
    is not listed. Without items nothing is hit. Items beyond ``PASS_WORDS`` words are searched in further passes
    over ``docs``, each written to the shared folder. No shuffle of ``docs``.
    """
    new = ("n_words", "spans", "item_ids")
    named = [c for c in docs.columns if c not in new]
    kept = [c for c in (keep or named) if c not in new]
    out = docs.select(*dict.fromkeys([*kept, "text"])).withColumns({
        "n_words": F.lit(0).cast("bigint"),
        "spans": F.lit(None).cast("array<struct<start:int,end:int>>"),
        "item_ids": F.lit(None).cast("array<bigint>"),
    })
    passes = _passes(items)
    pieces, following = next(passes, []), next(passes, None)
    while following is not None:
        out = cut(out.mapInArrow(_search(share(docs.sparkSession, Pass(pieces)), out.columns), out.schema))
        pieces, following = following, next(passes, None)
    last = out.select(*kept, *new)
    return out.mapInArrow(_search(share(docs.sparkSession, Pass(pieces)), last.columns), last.schema)


def _search(held, names: list[str]):
    def run(batches):
        searcher = held().searcher()
        stretch = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            col = {name: batch.column(name) for name in batch.schema.names}
            counts, spans, items = [], [], []
            for text, old, old_items in zip(*(col[c].to_pylist() for c in ("text", "spans", "item_ids")), strict=True):
                w = words(text)
                found, ids = searcher.spans(w)
                counts.append(len(w))
                spans.append([{"start": a, "end": b} for a, b in merged(found + [(s["start"], s["end"]) for s in old or ()])])
                items.append(sorted({*ids, *(old_items or ())} - {None}))
            col |= {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, stretch), "item_ids": pa.array(items, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([col[n] for n in names], names)

    return run


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts, the digest of its items, and whether anything was hit."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any word in a test window; columns as they came."""
    found = contamination(docs, items)
    return found.where(F.size("spans") == 0).select(*docs.columns)

"""Exact ranked lexical search: impact vectors ordered by length, buckets pruned by the Cauchy-Schwarz bound.

A document's impact vector has a coordinate for every query term it holds. Vectors are range-partitioned by length,
longest first, and cut in buckets. For a query and a bucket: (1) the bucket goes if the query's length times its
longest vector is below the query's k-th best score so far; (2) inside, vectors are cut off at the length where the
same bound falls below it; (3) the query's coordinates are multiplied out from the largest down, and a vector goes when these and
the bound on all others stay below; (4) what is left is scored exactly in whole numbers. Bounds are doubles with a margin;
they never decide a score, only what cannot reach one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import materialise, share, slices

# Fixed by the scoring rule: weights in thousandths, tf saturated as a fraction of a million.
WEIGHT, SCALE, TF, LENGTH, FLOOR, SLOPE = 1000, 1_000_000_000, 1000, 8, 25, 75
# Query words a pass holds (a query longer than that has a pass of its own); vectors a bucket; coordinates multiplied out
# between two looks at the bound; so few vectors of a bucket are scored at once.
PASS_WORDS, BUCKET, FOCUS, FEW = 100_000, 1024, 6, 8
# Vectors from whose exact scores the first k-th best of every query is taken; any number gives the same result.
SEED_ROWS = 20_000
MARGIN = 1 + 1e-9
PARTS = 64

TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

VECTORS = "doc_id bigint, n bigint, terms binary, counts binary"
FOUND = "query int, item_id bigint, doc_id bigint, score bigint"


def terms(text: str | None) -> list[bytes]:
    """ASCII letters and digits, A-Z made small, and all that is not ASCII; the rest separates."""
    return text.encode().translate(TERMS).split() if text else []


class Queries:
    """One pass of queries, with their vocabulary numbered; broadcast. ``weigh`` adds what the corpus says."""

    def __init__(self, items: list[tuple[int | None, list[bytes], list[int]]]):
        self.ids = [i for i, _, _ in items]
        self.vocab = {t: n for n, t in enumerate(sorted({t for _, ts, _ in items for t in ts}))}
        self.queries = [(np.array([self.vocab[t] for t in ts], np.int64), np.array(c, np.int64)) for _, ts, c in items]

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray, k: int, floors: dict[int, int]) -> Queries:
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k
        self.weights = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        self.floors = [floors.get(q, 1) for q in range(len(self.queries))]
        return self

    def impacts(self, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What a term adds to a score per unit of weight, given its document's length and its occurrences."""
        m = FLOOR + (SLOPE * lengths * self.n_docs) // self.n_terms
        return (SCALE * counts) // (TF * counts + LENGTH * m)


def _passes(items: DataFrame) -> Iterator[Queries]:
    """Distinct items as term counts, streamed to the driver and dealt into passes of bounded size."""
    def count(batches):
        for batch in batches:
            rows = [(i, Counter(terms(t))) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [(i, c) for i, c in rows if c]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), pa.array([list(c) for _, c in rows], pa.list_(pa.binary())), pa.array([list(c.values()) for _, c in rows], pa.list_(pa.int64()))],
                ["item_id", "terms", "counts"],
            )

    distinct = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    batch, held = [], 0
    for row in distinct.mapInArrow(count, "item_id bigint, terms array<binary>, counts array<bigint>").toLocalIterator():
        if batch and held + len(row.terms) > PASS_WORDS:
            yield Queries(batch)
            batch, held = [], 0
        batch.append((row.item_id, [bytes(t) for t in row.terms], list(row.counts)))
        held += len(row.terms)
    if batch:
        yield Queries(batch)


def vectors(docs: DataFrame, queries: Queries) -> DataFrame:
    """Per document its number of terms and, for the terms of the pass, their numbers and counts; one scan, no shuffle."""
    held = share(docs.sparkSession, queries)

    def run(batches):
        vocab = held().vocab
        for batch in slices(batches):
            lengths, numbers, counts = [], [], []
            for text in batch.column("text").to_pylist():
                found = terms(text)
                lengths.append(len(found))
                at, n = np.unique(np.fromiter([v for t in found if (v := vocab.get(t)) is not None], np.int32), return_counts=True)
                numbers.append(at.tobytes())
                counts.append(n.astype(np.int32).tobytes())
            arrays = [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, VECTORS)


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the pass occurs: added up in the tasks, then by term."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(ints(batch.column(0)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "n"])

    df = np.zeros(size, np.int64)
    for row in rows.select("terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[row.term] = row.n
    return df


def ints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def with_norms(rows: DataFrame, queries: Queries) -> DataFrame:
    """Rows that hold a query term, with the length of their impact vector, weights shared out by their roots."""
    held = share(rows.sparkSession, queries)

    def run(batches):
        q = held()
        for batch in batches:
            at, counts = ints(batch.column("terms")), ints(batch.column("counts")).astype(np.int64)
            sizes = np.array([len(t) // 4 for t in batch.column("terms").to_pylist()], np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            lengths = batch.column("n").to_numpy()
            p = q.impacts(lengths[row], counts)
            norms = np.sqrt(np.bincount(row, p.astype(float) ** 2 * q.weights[at], len(sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(norms), *batch.columns], ["norm", *batch.schema.names])

    return rows.mapInArrow(run, "norm double, " + VECTORS).where(F.col("norm") > 0)


class Bucket:
    """Vectors of similar length, longest first, by row and by term."""

    def __init__(self, batch: pa.RecordBatch, q: Queries):
        self.ids = batch.column("doc_id").to_numpy(zero_copy_only=False) if not batch.column("doc_id").null_count else np.array([-(1 << 63) if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
        self.norms = batch.column("norm").to_numpy()
        self.terms = ints(batch.column("terms"))
        sizes = np.array([len(t) // 4 for t in batch.column("terms").to_pylist()], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        self.impacts = q.impacts(batch.column("n").to_numpy()[row], ints(batch.column("counts")).astype(np.int64))
        order = np.argsort(self.terms, kind="stable")
        self.by_term, self.rows = self.terms[order], row[order]
        self.scaled = self.impacts[order] * np.sqrt(q.weights[self.by_term])

    def holders(self, term: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``upto`` rows that hold the term, and their coordinates."""
        low, high = np.searchsorted(self.by_term, [term, term + 1])
        rows = self.rows[low:high]
        n = np.searchsorted(rows, upto)
        return rows[:n], self.scaled[low : low + n]

    def exact(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores in whole numbers; ``weights`` has the query's weight of every term."""
        starts, sizes = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at], ends - sizes)


class Search:
    """The best documents of every query so far in one task, and what a score must reach to count."""

    def __init__(self, q: Queries):
        self.q = q
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q.queries]
        self.least = list(q.floors)
        self.queries = []
        for at, n in q.queries:
            size = n * np.sqrt(q.weights[at])
            order = np.argsort(-size, kind="stable")
            self.queries.append((at[order], size[order], n[order]))
        self.norms = np.array([np.sqrt(np.sum(size**2)) for _, size, _ in self.queries])
        self.tried = self.scored = 0

    def bucket(self, b: Bucket) -> None:
        longest = b.norms[0] * MARGIN
        for i in np.flatnonzero(self.norms * longest >= np.array(self.least)):
            at, size, n = self.queries[i]
            least = self.least[i]
            upto = int(np.searchsorted(-b.norms, -least / (self.norms[i] * MARGIN), side="right"))
            self.tried += upto
            product, used = np.zeros(upto), np.zeros(upto)
            for start in range(0, len(at), FOCUS):
                for term, s in zip(at[start : start + FOCUS], size[start : start + FOCUS], strict=True):
                    rows, values = b.holders(term, upto)
                    product[rows] += s * values
                    used[rows] += values * values
                rest = np.sqrt(np.sum(size[start + FOCUS :] ** 2))
                square = b.norms[:upto] ** 2
                # what the other coordinates can add at most; rounding may leave the last bits of ``square``
                bound = product + rest * np.sqrt(np.maximum(square - used, 0) + square * 1e-12)
                rows = np.flatnonzero(bound * MARGIN >= least)
                if len(rows) <= FEW:
                    break
                upto = int(rows[-1]) + 1
                product, used = product[:upto], used[:upto]
            if len(rows):
                self.scored += len(rows)
                weights = np.zeros(len(self.q.weights), np.int64)
                weights[at] = n * self.q.weights[at]
                self.add(i, b.ids[rows], b.exact(rows, weights))

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least[i]  # an equal score may win by its id
        if not good.any():
            return
        ids, scores = np.concatenate([self.best[i][0], ids[good]]), np.concatenate([self.best[i][1], scores[good]])
        order = np.lexsort((ids, -scores))[: self.q.k]
        self.best[i] = ids[order], scores[order]
        if len(order) == self.q.k:
            self.least[i] = max(self.least[i], int(scores[order][-1]))


def found(rows: DataFrame, queries: Queries) -> DataFrame:
    """Of each partition of ``rows``, longest vectors first, the best of every query."""
    held = share(rows.sparkSession, queries)

    def run(batches):
        search = Search(held())
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET):
                search.bucket(Bucket(batch.slice(start, BUCKET), search.q))
        n = [len(ids) for ids, _ in search.best]
        numbers = np.repeat(np.arange(len(n), dtype=np.int32), n)
        ids = [None if d == -(1 << 63) else int(d) for best, _ in search.best for d in best]
        arrays = [pa.array(numbers), pa.array([search.q.ids[i] for i in numbers], pa.int64()), pa.array(ids, pa.int64()), pa.array([int(s) for _, best in search.best for s in best], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["query", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, FOUND)


def best(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, ranked. First among the rows of one in ``PARTS``, so that many tasks' bests are not sorted in one."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    first = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    return first.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` for every item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and ``text``; other columns change nothing. Only scores above 0
    count, so an item may have fewer rows or none; equal scores go by ``doc_id``, NULL first. A NULL or empty text has
    no terms, as a document (which then counts for no statistics) or as an item (which then has no rows). Every row is a
    document, equal ids or not; identical items count once, items that share an id but not a text are ranked apart. Statistics
    are of all documents. Items beyond ``PASS_WORDS`` terms are searched in further passes over ``docs``.
    """
    out = None
    for queries in _passes(items):
        rows = materialise(vectors(docs, queries), "search-vectors")
        total = rows.where(F.col("n") > 0).agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not total.docs:
            break
        df = document_counts(rows, len(queries.vocab))
        queries.weigh(total.docs, total.terms, df, k, {})
        hash32 = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 32))
        seed = with_norms(rows.where(hash32 < int(min(1, SEED_ROWS / total.docs) * (1 << 32))), queries)
        # A k-th best of some documents is at most that of all; a query with fewer than k there starts from 1.
        floors = best(found(seed.sortWithinPartitions(F.desc("norm")), queries), k).where(F.col("rank") == k)
        queries.weigh(total.docs, total.terms, df, k, {r.query: r.score for r in floors.toLocalIterator()})
        ordered = with_norms(rows, queries).repartitionByRange(F.desc("norm"), "doc_id").sortWithinPartitions(F.desc("norm"), "doc_id")
        done = best(found(ordered, queries), k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        # a further pass reads the documents anew: what is done is kept
        out = done if out is None else materialise(out, "search-found").unionByName(done)
    return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out

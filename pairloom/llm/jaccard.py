"""N-gram Jaccard join: which documents share most of their word n-grams.

Sets of shingles are joined through prefix trees. Identical sets are one from the start. Under one global
order of shingles, rare ones first, two sets as similar as asked share a shingle among the first few of both; sets that
do, directly or through others, form a cluster. Inside a cluster each set is a path in a trie, its shingles
ordered by how many sets have them; a set is compared with all others by one walk that counts overlaps
once for shared paths and leaves a branch as soon as its remaining length cannot reach the overlap needed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import WordHashes, added_up, blank_separated, dense_counts, hashed, in_pieces, materialise, mix, share, shingles, slices
from pairloom.llm.components import components

SHINGLE = 4
# Least similarity in hundredths.
PERCENT = 85
# Counters that the order of shingles is taken from, a fixed size, and the least number of marks for which sets have a cluster.
COUNTERS, MARKS = 1 << 22, 1 << 22
# Groups up to this size are written out as pairs, at most 28 a group; larger ones hang together by one member.
SMALL_GROUP = 8
# Shingles in a task's half of a cluster.
BLOCK_SHINGLES = 250_000


def shingle_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of rows with the sorted, distinct 64-bit hashes of every text's shingles."""
    memo = WordHashes()
    for batch in slices(batches):
        yield batch, [np.unique(shingles(hashed(blank_separated(t), memo), k)) for t in batch.column("text").to_pylist()]


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed words."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    """Two sets that are similar enough have in common, of so many first shingles of both, in any global order, as
    many as ``needed`` says for the smaller one.

    A similar set has at least percent * n / 100 shingles in common with this one. Behind the j-th of the common
    shingles come all the other common ones, so it stands among the first n - percent * n / 100 + j of either set.
    """
    return n - -(-percent * n // 100) + needed(n)


def needed(n: int) -> int:
    """Common first shingles asked of a set of ``n``: the more there are, the fewer unlike sets pass."""
    return min(4, 1 + n // 40)


class Node:
    """A stretch of a path in the trie; ``ends`` are the sets whose path ends here."""

    __slots__ = ("part", "members", "depth", "below", "ends", "low", "high", "one")

    def __init__(self, part: np.ndarray, depth: int):
        self.part, self.members, self.depth = part, frozenset(part.tolist()), depth
        self.below: dict[int, Node] = {}
        self.ends: list[int] = []
        self.low, self.high, self.one = 1 << 60, 0, None


class Trie:
    """Sets as paths; ``classes`` are a union-find over the sets' numbers, so that linked sets are not compared again."""

    def __init__(self, count: int, percent: int):
        self.root, self.percent = Node(np.array([], np.int64), 0), percent
        self.classes = list(range(count))

    def find(self, i: int) -> int:
        while self.classes[i] != i:
            self.classes[i] = self.classes[self.classes[i]]
            i = self.classes[i]
        return i

    def insert(self, number: int, path: np.ndarray) -> None:
        node, at, n = self.root, 0, len(path)
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if node.one is None and not node.below and not node.ends:
                node.one = number
            elif node.one is not None and self.find(node.one) != self.find(number):
                node.one = None
            if at == n:
                node.ends.append(number)
                return
            child = node.below.get(int(path[at]))
            if child is None:
                child = node.below[int(path[at])] = Node(path[at:], n)
                child.low = child.high = n
                child.one = number
                child.ends.append(number)
                return
            m = min(len(child.part), n - at)
            differ = np.flatnonzero(child.part[:m] != path[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.part):  # split the stretch where the paths part
                upper = Node(child.part[:same], at + same)
                lower = Node(child.part[same:], child.depth)
                for name in ("below", "ends", "low", "high", "one"):
                    setattr(lower, name, getattr(child, name))
                upper.low, upper.high, upper.one = child.low, child.high, child.one
                upper.below = {int(lower.part[0]): lower}
                node.below[int(path[at])] = child = upper
            node, at = child, at + same

    def link(self, number: int, path: np.ndarray) -> None:
        """Join the set's class with that of every set in the trie that is similar enough."""
        p, n, order = self.percent, len(path), path.tolist()
        own = frozenset(order)
        todo = [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            if node.one is not None and self.find(node.one) == self.find(number):
                continue
            if p * node.low > 100 * n or p * n > 100 * node.high:
                continue
            overlap += len(own & node.members)
            # what the branch's longest set, and what the rest of this one, can still add; the overlap
            # needed with a set of m is p (n + m) / (100 + p)
            rest = n - bisect_right(order, int(node.part[-1])) if len(node.part) else n
            if (100 + p) * (overlap + node.high - node.depth) < p * (n + node.high) or (100 + p) * (overlap + rest) < p * (n + node.low):
                continue
            for other in node.ends:
                if 100 * overlap >= p * (n + node.depth - overlap):
                    a, b = self.find(other), self.find(number)
                    self.classes[max(a, b)] = min(a, b)
            todo += [(child, overlap) for child in node.below.values()]


def trie_links(first: list[np.ndarray], second: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of numbers that connect the same sets as all links do; within ``first``, or between it and ``second``.

    Sets of ``second`` are numbered on after those of ``first``.
    """
    sets = first + (second or [])
    if not sets:
        return []
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    borders = np.cumsum([0, *map(len, sets)])
    paths = [np.sort(rank[place[a:b]]) for a, b in zip(borders, borders[1:], strict=False)]
    trie = Trie(len(sets), percent)
    by_size = sorted(range(len(first)), key=lambda i: len(paths[i]))
    if second is None:
        for i in by_size:
            trie.link(i, paths[i])
            trie.insert(i, paths[i])
    else:
        for i in by_size:
            trie.insert(i, paths[i])
        for j in range(len(first), len(sets)):
            trie.link(j, paths[j])
    return [(i, r) for i in range(len(sets)) if (r := trie.find(i)) != i]


def similar(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id``.

    Words stand between blanks, A-Z in lower case; a set holds the distinct runs of ``k`` words, or the whole text
    if it has fewer. Two rows link when 100 times their sets' intersection is at least ``percent`` times the union. ``component_id`` is the
    smallest ``doc_id`` reachable by links, itself included. Empty and NULL texts link with nothing. Repeated ids are
    rows of their own and share a class. A row without id gets the class of rows with the same set, else NULL.

    Shingles are 64-bit hashes. Texts are read three times and never shuffled; what is shuffled are the first shingles of
    each distinct set, and whole sets only where there is a cluster. A cluster beyond ``BLOCK_SHINGLES`` is cut into
    blocks by size and hash, and blocks of neighbouring sizes are compared task by task.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spark = docs.sparkSession
    read = materialise(texts.mapInArrow(_keys(k), "doc_id bigint, k1 bigint, k2 bigint, n bigint, piece int, counts binary"), "keys")
    keyed = read.where("piece IS NULL").select("doc_id", "k1", "k2", "n")
    order = share(spark, np.minimum(added_up(read.where("piece IS NOT NULL").select("piece", "counts"), COUNTERS), 65_535).astype(np.uint16))
    # what several steps read is written, lest every plan holds it anew: many exchanges at once take much of the driver's memory
    sets = materialise(keyed.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "sets")

    # sets that share one of their first shingles, directly or through others, are a cluster
    entries = texts.select("text").mapInArrow(_first_shingles(k, percent, order), "token bigint, k1 bigint, n int")
    entries = materialise(entries, "entries")
    # the first shingles move once, and what only one set has is left behind
    of = Window.partitionBy("token")
    groups = entries.select("*", F.min("k1").over(of).alias("low"), F.max("k1").over(of).alias("high"), F.count("*").over(of).alias("held"))
    held = materialise(groups.where("low <> high").drop("low", "high"), "held")
    # small groups are pairs, of which those stay that are of like size, which is seen before they move, and share enough
    # first shingles; members of a larger group hang below its least, whatever their number
    few = held.where(f"held <= {SMALL_GROUP}").groupBy("token").agg(F.collect_list(F.struct("k1", "n")).alias("of"))
    sides = few.select(F.explode("of").alias("p"), "of").select("p", F.explode("of").alias("q")).where("p.k1 < q.k1")
    sides = sides.where(f"100L * p.n >= {percent}L * q.n AND 100L * q.n >= {percent}L * p.n")
    close = sides.groupBy(F.col("p.k1").alias("a"), F.col("q.k1").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("p.n", "q.n")).alias("least"))
    close = materialise(close.where("shared >= least(4, 1 + least div 40)").select("a", "b"), "close")
    # similar sets are in the same or in neighbouring bands of sizes: a set also joins the group of the next band
    bands = F.sequence(_band(F.col("n"), percent), _band(F.col("n"), percent) + 1)
    many = held.where(f"held > {SMALL_GROUP}").select("token", "k1", F.explode(bands).alias("band"))
    lows = many.groupBy("token", "band").agg(F.min("k1").alias("low"))
    hung = many.join(lows, ["token", "band"]).where("k1 <> low").select("k1", "low").distinct()
    clusters = components(close.unionAll(hung)).select(F.col("id").alias("k1"), F.col("component").alias("cluster"))

    members = sets.where("rep IS NOT NULL").join(clusters, "k1")
    members = materialise(members.withColumn("band", _band(F.col("n"), percent)), "members")
    # a cluster that fits is one block; a larger one has blocks of sets of like size
    by_band = materialise(members.groupBy("cluster", "band").agg(F.sum("n").alias("held")), "bands")
    whole = by_band.groupBy("cluster").agg(F.sum("held").alias("total"))
    parts = by_band.join(whole, "cluster").select(
        "cluster", "band", F.when(F.col("total") <= BLOCK_SHINGLES, 0).otherwise(F.col("band")).alias("row"),
        F.when(F.col("total") <= BLOCK_SHINGLES, 1).otherwise(F.ceil(F.col("held") / BLOCK_SHINGLES)).alias("parts"),
    )
    placed = members.join(parts, ["cluster", "band"]).withColumn("part", F.pmod("k2", "parts")).select("k1", "k2", "rep", "cluster", "row", "part")
    placed = materialise(placed, "placed")
    blocks = materialise(placed.select("cluster", "row", "part").distinct(), "blocks")
    right = blocks.select("cluster", F.explode(F.array(F.col("row"), F.col("row") - 1)).alias("row"), F.col("row").alias("row_2"), F.col("part").alias("part_2"))
    pairs = blocks.join(right, ["cluster", "row"]).where("row < row_2 OR part <= part_2")
    pairs = materialise(pairs.withColumn("task", F.xxhash64("cluster", "row", "part", "row_2", "part_2")), "pairs")
    sides = pairs.select("task", "cluster", "row", "part", F.lit(0).alias("side")).unionAll(
        pairs.where("row <> row_2 OR part <> part_2").select("task", "cluster", F.col("row_2").alias("row"), F.col("part_2").alias("part"), F.lit(1).alias("side"))
    ).distinct()
    tasks = materialise(placed.join(sides, ["cluster", "row", "part"]).select("k1", "k2", "rep", "task", "side"), "tasks")

    # whole sets are made again from the texts that stand for a member (a mark may let others pass to the join)
    room = room_for(members.count())
    chosen = _sets(k, share(spark, np.packbits(dense_counts(members.select("rep"), _marks(room), room) > 0)))
    full = texts.where("doc_id IS NOT NULL").mapInArrow(chosen, "rep bigint, k1 bigint, k2 bigint, tokens binary")
    work = full.join(tasks, ["k1", "k2", "rep"]).select("task", "side", "rep", "tokens")
    links = work.groupBy("task").applyInArrow(_trie_task(percent), "a bigint, b bigint")
    classes = components(links)
    reps = sets.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    return keyed.join(reps, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _keys(k: int):
    """A row a text, and at the end of a task the counts of the shingles of its distinct sets."""
    names = ["doc_id", "k1", "k2", "n", "piece", "counts"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]

    def run(batches):
        total, seen = np.zeros(COUNTERS, np.int32), set()
        for batch, sets in shingle_sets(batches, k):
            keys = [set_key(s) for s in sets]
            for _, s in _new(sets, seen):
                np.add.at(total, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            columns = [batch.column("doc_id"), *([x[i] for x in keys] for i in (0, 1)), list(map(len, sets)), [None] * len(sets), [None] * len(sets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        pieces, counts = in_pieces(total)
        empty = [None] * len(pieces)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([empty] * 4 + [pieces, counts], kinds, strict=True)], names)

    return run


def _new(sets: list[np.ndarray], seen: set[tuple[int, int]]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Sets that the task has not met yet; what it remembers is bounded, and a set met twice does no harm."""
    for s in sets:
        if len(s):
            key = set_key(s)
            if key not in seen:
                if len(seen) > 50_000:
                    seen.clear()
                seen.add(key)
                yield key, s


def _first_shingles(k: int, percent: int, order):
    def run(batches):
        counts, seen = order(), set()
        for _, sets in shingle_sets(batches, k):
            tokens, keys, sizes, whole = [], [], [], []
            for (k1, _), s in _new(sets, seen):
                m = prefix_length(len(s), percent)
                rarest = np.lexsort((s, counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:m]
                tokens.append(s[rarest])
                keys.append(k1)
                sizes.append(m)
                whole.append(len(s))
            all_tokens = np.concatenate(tokens).view(np.int64) if tokens else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(all_tokens), pa.array(np.repeat(np.array(keys, np.int64), sizes)), pa.array(np.repeat(np.array(whole, np.int32), sizes))], ["token", "k1", "n"])

    return run


def room_for(ids: int) -> int:
    """Marks for so many ids, a power of two: eight an id or more, so that the part of other rows that share one does not grow."""
    return max(MARKS, 1 << (8 * ids - 1).bit_length()) if ids else MARKS


def _spot(values: pa.Array, room: int) -> np.ndarray:
    return (mix(values.to_numpy().view(np.uint64)) & np.uint64(room - 1)).astype(np.int64)


def _marks(room: int):
    def run(batches):
        for batch in batches:
            yield _spot(batch.column(0), room)

    return run


def _marked_rows(held):
    def run(batches):
        marks = np.unpackbits(held())
        for batch in batches:
            yield batch.filter(pa.array(marks[_spot(batch.column(0), len(marks))] > 0))

    return run


def _band(n: Column, percent: int) -> Column:
    """Sets of two bands that are not neighbours differ too much in size to be similar."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("bigint")


def _sets(k: int, held):
    def run(batches):
        for batch, sets in shingle_sets(_marked_rows(held)(batches), k):
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["rep", "k1", "k2", "tokens"],
            )

    return run


def _trie_task(percent: int):
    def run(table: pa.Table) -> pa.Table:
        halves: tuple[dict, dict] = ({}, {})
        for side, rep, tokens in zip(*(table.column(c).to_pylist() for c in ("side", "rep", "tokens")), strict=True):
            halves[side].setdefault((rep, tokens), tokens)
        ids = [rep for half in halves for rep, _ in sorted(half)]
        first, second = ([np.frombuffer(half[key], np.uint64) for key in sorted(half)] for half in halves)
        found = trie_links(first, second or None, percent)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return run


def first_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each class of similar documents: that with the smallest id; columns as they came.

    Of rows with the same id one stays, the least by its columns. Empty texts and rows without id all stay.
    """
    found = materialise(similar(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    kept = docs.join(found, "doc_id", "left_anti")
    least = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return least.unionByName(kept.where("doc_id IS NULL"))

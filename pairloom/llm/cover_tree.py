"""Embedding near-duplicates: all pairs of one label above a cosine, through cover trees.

On unit vectors a cosine is a distance: |u - v|^2 = 2 - 2 cos. Each label's vectors are cut into blocks of
bounded size, neighbours together; pairs of blocks whose covering balls lie too far apart are left out. A task
compares two blocks: each gets a cover tree, whose nodes at each level cover their points within half the
radius of the level above, and the two trees are walked together. A pair of nodes is dropped when its balls
cannot hold a close pair, and taken whole when they cannot hold any other; the rest goes down to nodes whose vectors
are few, or do not gather in smaller balls, and these are compared vector by vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialise
from pairloom.llm.components import components

COSINE = 0.98
# Vectors in a block, on average; two blocks and their trees fit easily in a task.
BLOCK = 1_024
# Vectors below which a node is not split.
LEAF = 24
# Vectors that a node's balls must hold on average: where they hold fewer, comparing balls costs more than comparing the vectors in one product.
GATHER = 16
# Slack of distance bounds against rounding; decisions between single vectors are made on cosines.
SLACK = 1e-6


class Node:
    """A ball: centre, radius over its points, the points' numbers, and balls of half the radius inside."""

    __slots__ = ("centre", "radius", "points", "children")

    def __init__(self, x: np.ndarray, points: np.ndarray, centre: np.ndarray, reach: float):
        self.centre, self.points = centre, points
        d = np.sqrt(np.maximum(0, 2 - 2 * (x[points] @ centre)))
        self.radius = float(d.max())
        self.children: list[Node] = []
        if len(points) > LEAF and self.radius > SLACK:
            while reach >= self.radius:
                reach /= 2
            left, dist, inside = points, d, []
            while len(left) and len(inside) * GATHER <= len(points):
                # the farthest uncovered point becomes the centre of a child and takes what lies within reach
                c = x[left[dist.argmax()]]
                near = np.sqrt(np.maximum(0, 2 - 2 * (x[left] @ c))) <= reach
                near[dist.argmax()] = True
                inside.append((left[near], c))
                left, dist = left[~near], dist[~near]
            if not len(left):
                self.children = [Node(x, held, c, reach) for held, c in inside]


def tree(x: np.ndarray) -> Node:
    return Node(x, np.arange(len(x)), x[0], 2.0)


def close_pairs(a: np.ndarray, b: np.ndarray | None, cosine: float):
    """Blocks (i, j) of numbers of rows of ``a`` and ``b`` that are all close pairs: arrays, or two sets to combine.

    With ``b`` None pairs within ``a``, each once. Yields (rows of a, rows of b, paired): element by element if paired,
    otherwise every row with every other.
    """
    limit = float(np.sqrt(2 - 2 * cosine))
    left, right = tree(a), tree(b) if b is not None else None
    todo = [(left, right or left)]
    other = a if b is None else b
    while todo:
        p, q = todo.pop()
        same = b is None and p is q
        gap = 0.0 if same else float(np.sqrt(max(0.0, 2 - 2 * float(p.centre @ q.centre))))
        if gap > p.radius + q.radius + limit + SLACK:
            continue
        if not same and gap + p.radius + q.radius < limit - SLACK:
            yield p.points, q.points, False
            continue
        if same and 2 * p.radius < limit - SLACK:
            yield p.points, p.points, False
            continue
        if same:
            if p.children:
                todo += [(c, d) for i, c in enumerate(p.children) for d in p.children[i:]]
                continue
        elif p.children and (not q.children or p.radius >= q.radius):
            todo += [(c, q) for c in p.children]
            continue
        elif q.children:
            todo += [(p, c) for c in q.children]
            continue
        i, j = np.nonzero(a[p.points] @ other[q.points].T >= cosine)
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            yield p.points[i], q.points[j], True


def linked(a: np.ndarray, b: np.ndarray | None, wa: np.ndarray, wb: np.ndarray | None, cosine: float):
    """Weighted number of links of each row, and edges (row, row) that connect the same rows as the links do.

    Rows of ``b`` are numbered after those of ``a``.
    """
    n = len(a)
    counts = np.zeros(n + (0 if b is None else len(b)), np.int64)
    weights = wa if b is None else np.concatenate([wa, wb])
    parent = list(range(len(counts)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    shift = 0 if b is None else n
    for i, j, paired in close_pairs(a, b, cosine):
        j = j + shift
        if paired:
            np.add.at(counts, i, weights[j])
            np.add.at(counts, j, weights[i])
            for s, t in zip(i.tolist(), j.tolist(), strict=True):
                join(s, t)
        elif b is None and i is not None and len(i) == len(j) and np.array_equal(i, j):
            counts[i] += weights[i].sum() - weights[i]
            for t in i[1:].tolist():
                join(int(i[0]), t)
        else:
            counts[i] += weights[j].sum()
            counts[j] += weights[i].sum()
            for t in [*i[1:].tolist(), *j.tolist()]:
                join(int(i[0]), t)
    edges = [(i, r) for i in range(len(counts)) if (r := find(i)) != i]
    return counts, edges


def _unit(batches):
    """Usable vectors as unit vectors of doubles in bytes."""
    for batch in batches:
        ids, labels, keys = [], [], []
        for vec, label, values in zip(*(batch.column(c) for c in ("vec_id", "label", "embedding")), strict=True):
            v = values.as_py()
            if v is None or not label.is_valid or not vec.is_valid or any(e is None for e in v):
                continue
            x = np.array(v, np.float64)
            top = np.abs(x).max() if len(x) else 0.0
            if not np.isfinite(x).all() or top == 0:
                continue
            x = x / top  # so that squares neither overflow nor vanish
            ids.append(vec.as_py())
            labels.append(str(label.as_py()))
            keys.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(keys, pa.binary())], ["vec_id", "label", "unit"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and their cosine, in doubles, is at least ``cosine``; vectors of
    different lengths do not. A row with a NULL id or label, or a vector that is NULL, empty, zero or holds NULL or non-finite
    components, links with nothing and is its own class. Rows with the same vector are compared once, as one with a weight. Repeated ids
    are rows of their own in counts and share a class. ``cosine`` must be above 0.

    Blocks: a label's directions are dealt to cells by the signs of fixed random projections, and a cell of more than
    ``block`` of them to several blocks by hash, so that no task depends on the size of a label or of a group of near copies. Every block meets every other of its label that its
    ball can reach; what a task returns is at most a row and an edge a vector.
    """
    units = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding").mapInArrow(_unit, "vec_id bigint, label string, unit binary")
    units = materialise(units, "units")
    # the same direction once, with its weight; its name is the smallest id
    distinct = units.groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    sizes = distinct.groupBy("label", F.length("unit").alias("width")).count()
    projected = distinct.withColumn("width", F.length("unit")).join(sizes.withColumnRenamed("count", "n"), ["label", "width"]).mapInArrow(
        _place(block), "label string, width int, rep bigint, weight bigint, unit binary, block bigint"
    )
    cells = materialise(projected, "cells")
    # a cell of many vectors that lie close together is dealt to blocks by hash
    held = cells.groupBy("label", "width", "block").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = F.col("block") * (1 << 20) + F.pmod(F.xxhash64("rep"), F.col("parts"))
    placed = cells.join(held, ["label", "width", "block"]).select("label", "width", "rep", "weight", "unit", dealt.alias("block"))
    placed = materialise(placed, "placed")
    balls = placed.groupBy("label", "width", "block").agg(F.count("*").alias("n"), F.min_by("unit", F.xxhash64("rep")).alias("centre"))
    radii = placed.join(balls.select("label", "width", "block", "centre"), ["label", "width", "block"]).mapInArrow(_distance, "label string, width int, block bigint, d double")
    balls = materialise(balls.join(radii.groupBy("label", "width", "block").agg(F.max("d").alias("radius")), ["label", "width", "block"]), "balls")
    other = balls.select("label", "width", *[F.col(c).alias(f"{c}_2") for c in ("block", "centre", "radius")])
    pairs = balls.join(other, ["label", "width"]).where("block <= block_2").mapInArrow(_reach(cosine), "label string, width int, block bigint, block_2 bigint")
    pairs = materialise(pairs, "pairs").withColumn("task", F.xxhash64("label", "width", "block", "block_2"))
    sides = pairs.select("task", "label", "width", "block", F.lit(0).alias("side")).unionAll(
        pairs.where("block <> block_2").select("task", "label", "width", F.col("block_2").alias("block"), F.lit(1).alias("side"))
    )
    work = sides.join(placed, ["label", "width", "block"]).select("task", "side", "rep", "weight", "unit")
    found = materialise(work.groupBy("task").applyInArrow(_compare(cosine), "a bigint, b bigint, n bigint"), "found")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    classes = components(found.where("b IS NOT NULL").select("a", "b"))
    reps = distinct.join(links, "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left").select(
        "label", "unit", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    good = units.join(reps, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    per_id = good.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).join(per_id, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _place(block: int):
    """Number of the block: the signs of as many projections as halve the label down to ``block`` vectors."""
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for width, raw, n in zip(*(batch.column(c).to_pylist() for c in ("width", "unit", "n")), strict=True):
                bits = max(0, int(np.ceil(np.log2(max(1, n / block)))))
                x = np.frombuffer(raw)
                if width not in planes:
                    planes[width] = np.random.default_rng(width).standard_normal((40, len(x)))
                signs = planes[width][:bits] @ x > 0
                out.append(int(sum(1 << i for i, s in enumerate(signs) if s)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("label", "width", "rep", "weight", "unit")] + [pa.array(out, pa.int64())], ["label", "width", "rep", "weight", "unit", "block"])

    return run


def _distance(batches):
    for batch in batches:
        d = [float(np.linalg.norm(np.frombuffer(u) - np.frombuffer(c))) for u, c in zip(batch.column("unit").to_pylist(), batch.column("centre").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("label", "width", "block")] + [pa.array(d, pa.float64())], ["label", "width", "block", "d"])


def _reach(cosine: float):
    limit = float(np.sqrt(2 - 2 * cosine)) + SLACK

    def run(batches):
        for batch in batches:
            d = np.array([float(np.linalg.norm(np.frombuffer(a) - np.frombuffer(b))) for a, b in zip(batch.column("centre").to_pylist(), batch.column("centre_2").to_pylist(), strict=True)])
            near = pa.array(d <= batch.column("radius").to_numpy() + batch.column("radius_2").to_numpy() + limit) if len(d) else pa.array([], pa.bool_())
            yield batch.filter(near).select(["label", "width", "block", "block_2"])

    return run


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rep, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy()
        raw = table.column("unit").to_pylist()
        x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
        order = np.lexsort((rep, side))
        side, rep, weight, x = side[order], rep[order], weight[order], x[order]
        n = int((side == 0).sum())
        two = bool((side == 1).any()) and n > 0
        counts, edges = linked(x[:n], x[n:] if two else None, weight[:n], weight[n:] if two else None, cosine)
        some = np.flatnonzero(counts)
        a = [*rep[some].tolist(), *(int(rep[i]) for i, _ in edges)]
        b = [*[None] * len(some), *(int(rep[j]) for _, j in edges)]
        c = [*counts[some].tolist(), *[None] * len(edges)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(c, pa.int64())})

    return run

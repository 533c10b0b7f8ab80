"""Connected components of a graph given as edges, without any node's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of ``edges(a, b)``; component is the smallest id of the class.

    Edges may repeat, run both ways or join a node to itself; NULL ends are left out. An empty table gives
    an empty table. Each round hangs all larger neighbours of a node, then the node and its smaller
    neighbours, below the smallest id next to them. Minima are partial aggregates and the joins are
    plain equi-joins, which adaptive execution splits when one node has very many edges. Rounds grow with the
    logarithm of a class's width; each is written to the shared scratch folder.
    """
    pairs = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    pairs = materialise(pairs, "edges")
    seen = None
    while True:
        # large star: larger neighbours of a node go below the smallest id in its neighbourhood
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(pairs.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        # small star: a node and its smaller neighbours go below the smallest of them
        large = materialise(large.distinct(), "large")
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(below, "hi")
        pairs = materialise(
            moved.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionAll(below.select("hi", F.col("m").alias("lo"))).distinct(),
            "small",
        )
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("lo").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return roots.unionAll(pairs.select(F.col("hi").alias("id"), F.col("lo").alias("component")))

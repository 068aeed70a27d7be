"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` of every node of the edges ``(a, b)``; ``comp`` is its least node.

    Alternating large-star and small-star steps, each written to the shared folder,
    until nothing changes: about as many rounds as the logarithm of the longest
    path. All joins are shuffled, so that a hub's edges can be split by AQE. Without edges there are no rows.
    """
    e = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node keeps its link to its own least neighbour
        large = large.union(low.filter("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(down, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, stash(small.union(down.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        discard(old)
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select(F.col("b"), F.col("b"))).distinct()

"""Penalties, saturation of files, and the final cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.paths import penalty

DECAY = 0.5


def rerank(cand: DataFrame, k, penalise: Column | bool = True) -> DataFrame:
    """``(query_id, chunk_id, file_path, score, rank)``: the ``k`` best after penalties.

    The path's penalty comes first. Then the n-th chunk of a file counts ``0.5 ** (n - 1)``. Both
    are windows; no loop over a sorted list is needed, because a chunk's place within its
    file doesn't depend on other files.
    """
    hit = F.lit(penalise) if isinstance(penalise, bool) else penalise
    rows = cand.withColumn("pen", F.col("score") * F.when(hit, penalty(F.col("file_path"))).otherwise(1.0))
    nth = F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy(F.desc("pen"), "ord"))
    rows = rows.withColumn("eff", F.col("pen") * F.pow(F.lit(DECAY), nth - 1))
    w = Window.partitionBy("query_id").orderBy(F.desc("eff"), F.desc("pen"), "ord")
    out = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select("query_id", "chunk_id", "file_path", F.col("eff").alias("score"), "rank")


def cut(cand: DataFrame, k) -> DataFrame:
    """The ``k`` best as they are."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "file_path", "score", "rank")

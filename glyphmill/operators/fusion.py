"""Reciprocal-rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(rank: Column) -> Column:
    return F.lit(1.0) / (RRF_K + rank)


def rrf_rank(scored: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, score, rank, rrf)`` of ``(query_id, chunk_id, score)``; ties by chunk."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).withColumn("rrf", rrf(F.col("rank")))


def blend(semantic: DataFrame, lexical: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, sem_rank, bm_rank, score)`` of the union of both rankings.

    ``semantic`` has ``sem_rank``, ``lexical`` has ``bm_rank``, ``queries`` has ``alpha``,
    the weight of the semantic side. A chunk that one side lacks gets 0 from it.
    """
    both = semantic.select("query_id", "chunk_id", "sem_rank").join(lexical.select("query_id", "chunk_id", "bm_rank"), ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(rrf(F.col(c)), F.lit(0.0))
    a = F.col("alpha")
    return both.join(queries.select("query_id", "alpha"), "query_id").select("query_id", "chunk_id", "sem_rank", "bm_rank", (a * part("sem_rank") + (1.0 - a) * part("bm_rank")).alias("score"))


def candidates(blended: DataFrame, meta: DataFrame) -> DataFrame:
    """The blended rows with their chunk's ``file_path`` and an order ``ord`` that settles all later ties.

    It is by first line, then as the rankings found them, semantic before lexical.
    """
    rows = blended.join(meta.select("chunk_id", "file_path", "start_line"), "chunk_id")
    w = Window.partitionBy("query_id").orderBy("start_line", F.col("sem_rank").asc_nulls_last(), "bm_rank")
    return rows.select("query_id", "chunk_id", "file_path", "score", F.row_number().over(w).cast("long").alias("ord"))

"""Query plans: hybrid search and finding related chunks, for tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators import bm25, boosts, dense, fusion, lookup
from glyphmill.operators.rerank import cut, rerank

TOP_K, OVERFETCH = 5, 5


def hybrid(chunks: DataFrame, index: bm25.Postings, vectors: DataFrame, queries: DataFrame, top_k: int = TOP_K, reranked: bool = True, strict_filters: bool = False, filtered: bool = False) -> DataFrame:
    """``(query_id, chunk_id, file_path, score, rank)``: the best chunks of every query.

    ``queries(query_id, text, v, alpha)``: ``v`` is the text's vector, a null ``alpha`` is settled by the
    kind of query. Blank queries find nothing. With ``filtered``, columns ``filter_languages`` and
    ``filter_paths`` restrict both rankings before they are cut, while statistics stay those of
    the whole corpus; definitions that are brought in ignore filters unless ``strict_filters``.
    """
    if top_k < 1:
        return queries.sparkSession.createDataFrame([], "query_id long, chunk_id long, file_path string, score double, rank int")
    spec = boosts.query_spec(queries.filter(boosts.trimmed(F.col("text")) != ""))
    k = top_k * OVERFETCH
    near = dense.knn(vectors, spec, k, chunks if filtered else None)
    lexical = bm25.best(index, spec, k, "bm_rank", chunks if filtered else None)
    cand = fusion.candidates(fusion.blend(near, lexical, spec), chunks)
    if not reranked:
        return cut(cand, top_k)
    if filtered:  # queries whose filters match nothing find nothing
        spec = spec.join(lookup.selected(chunks, spec, once=True), "query_id", "left_semi")
    boosted = boosts.query_boost(boosts.file_coherence(cand), spec, chunks, filtered and strict_filters)
    # with the semantic side alone, paths aren't penalised
    return rerank(boosted.join(spec.select("query_id", "alpha"), "query_id"), top_k, F.col("alpha") < 1.0)


def related(vectors: DataFrame, seeds: DataFrame, top_k: int = TOP_K, seed_col: str = "chunk_id") -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the nearest chunks of each seed ``(query_id, chunk_id, v)``, without itself."""
    hits = dense.knn(vectors, seeds.select("query_id", "v"), top_k + 1)
    own = seeds.select(F.col("query_id").alias("sq"), F.col(seed_col).alias("seed"))
    rest = hits.join(own, F.col("query_id") == F.col("sq")).filter(~F.col("chunk_id").eqNullSafe(F.col("seed")))
    w = Window.partitionBy("query_id").orderBy("sem_rank")
    return rest.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).select("query_id", "chunk_id", F.col("similarity").alias("score"), "rank")

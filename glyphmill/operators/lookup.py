"""Chunks by place, and what an index holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import ship


def resolve(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """``(place_id, chunk_id)`` of every place ``(place_id, file_path, line)`` that a chunk covers.

    A chunk that goes on after the line is preferred to one that ends there; then the first.
    """
    c = chunks.select("chunk_id", "file_path", "start_line", "end_line")
    hits = places.join(c, "file_path").filter("start_line <= line and line <= end_line")
    w = Window.partitionBy("place_id").orderBy(F.when(F.col("line") < F.col("end_line"), 0).otherwise(1), "chunk_id")
    return hits.withColumn("n", F.row_number().over(w)).filter("n = 1").select("place_id", "chunk_id")


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: ``indexed_files``, ``total_chunks``."""
    return chunks.agg(F.count_distinct("file_path").alias("indexed_files"), F.count("*").alias("total_chunks"))


def languages(chunks: DataFrame) -> DataFrame:
    """``(language, chunks)``; chunks without a language don't count."""
    return chunks.filter("language is not null").groupBy("language").agg(F.count("*").alias("chunks"))


def passes(language: Column, path: Column, langs: Column, paths: Column) -> Column:
    """Whether a chunk passes a query's ``filter_languages`` and ``filter_paths``.

    A language must be one of those named (none counts as the empty string), a path must hold one of the strings;
    null or empty lists don't filter.
    """
    free = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    named = F.array_contains(langs, F.coalesce(language, F.lit("")))
    return (free(langs) | F.coalesce(named, F.lit(False))) & (free(paths) | F.coalesce(F.exists(paths, lambda p: path.contains(p)), F.lit(False)))


def passing(rows: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows ``(query_id, chunk_id, ...)`` that the queries' filters let pass; no other pairs are made."""
    q = queries.select(F.col("query_id").alias("of_query"), F.col("filter_languages").alias("of_langs"), F.col("filter_paths").alias("of_parts"))
    c = chunks.select(F.col("chunk_id").alias("of_chunk"), F.col("file_path").alias("of_path"), F.col("language").alias("of_lang"))
    full = rows.join(q, F.col("query_id") == F.col("of_query")).join(c, F.col("chunk_id") == F.col("of_chunk"))
    return full.filter(passes(F.col("of_lang"), F.col("of_path"), F.col("of_langs"), F.col("of_parts"))).select(*rows.columns)


def filter_kinds(queries: list) -> list[tuple[tuple, tuple, list[int]]]:
    """(languages, path parts, query ids) of the different filters of some rows of queries."""
    kinds: dict[tuple, list[int]] = {}
    for r in queries:
        kinds.setdefault((tuple(r.filter_languages or ()), tuple(p for p in r.filter_paths or () if p is not None) if r.filter_paths else ()), []).append(r.query_id)
    return [(a, b, ids) for (a, b), ids in kinds.items()]


def mask(language: pa.Array, path: pa.Array, langs: tuple, parts: tuple) -> np.ndarray:
    """:func:`passes` for a batch of chunks and one filter."""
    ok = np.ones(len(path), bool)
    if langs:
        ok &= pc.is_in(pc.fill_null(language, ""), value_set=pa.array([x for x in langs if x is not None], pa.string())).to_numpy(zero_copy_only=False)
    if parts:
        hit = np.zeros(len(path), bool)
        for p in parts:
            hit |= pc.fill_null(pc.match_substring(path, p), False).to_numpy(zero_copy_only=False)
        ok &= hit
    return ok


def in_blocks(queries: DataFrame, cost: Callable, most: int) -> Iterator[list]:
    """The rows of a table of queries in blocks of at most ``most`` of ``cost``; one block at a time is held."""
    held, size = [], 0
    for r in queries.toLocalIterator(prefetchPartitions=False):
        c = cost(r)
        if held and size + c > most:
            yield held
            held, size = [], 0
        held.append(r)
        size += c
    if held:
        yield held


def selected(chunks: DataFrame, queries: DataFrame, query_bytes: int = 8 << 20, once: bool = False) -> DataFrame:
    """``(query_id, chunk_id)`` that each query's filters let pass; with ``once`` only ``(query_id)`` that any chunk passes.

    The queries' filters go to the chunks in blocks of ``query_bytes``: a scan a block, no join and no shuffle of pairs.
    Queries with equal filters are looked at once.
    """
    spark = chunks.sparkSession
    ship(spark)
    size = lambda r: 64 + sum(len(x or "") + 16 for x in [*(r.filter_languages or ()), *(r.filter_paths or ())])
    rows = chunks.select("chunk_id", "file_path", "language")
    schema = "query_id long" if once else "query_id long, chunk_id long"
    out = None
    for block in in_blocks(queries.select("query_id", "filter_languages", "filter_paths"), size, query_bytes):
        shared = spark.sparkContext.broadcast(filter_kinds(block))

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in it:
                for k, (langs, parts, ids) in enumerate(shared.value):
                    if once and k in seen:
                        continue
                    hit = np.flatnonzero(mask(b.column(2), b.column(1), langs, parts))
                    if once and len(hit):
                        seen.add(k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["query_id"])
                    elif len(hit):
                        own = b.column(0).cast(pa.int64()).take(pa.array(hit))
                        for q in ids:
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), q, np.int64)), own], ["query_id", "chunk_id"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.distinct() if once else out

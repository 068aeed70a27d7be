"""The inverted index and BM25 over tables of chunks and of queries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.paths import enrich
from glyphmill.functions.tokens import ordered_terms, term_counts, unique_tokens
from glyphmill.operators.lookup import filter_kinds, in_blocks, mask, passing
from glyphmill.session import ship

K1, B = 1.5, 0.75
#: Bytes of queries' texts that go to all workers at once, chunks that are scored at once, and scores from which on a batch is given out.
QUERY_BYTES, SLICE, MOST = 4 << 20, 2048, 1 << 18


class Postings(NamedTuple):
    """The index: ``postings(term, chunk_id, tf, dl)``, ``terms(term, df)``, ``corpus(n, avgdl)`` of one row, and what they were made of."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    counted: DataFrame | None = None


def chunk_terms(chunks: DataFrame, enriched: bool = True) -> DataFrame:
    """``(chunk_id, dl, terms, tfs)``: the number of tokens, the distinct ones, and how often each occurs.

    Texts are read whole, in Arrow batches; a null text has no tokens.
    """
    ship(chunks.sparkSession)
    text = enrich(F.col("content"), F.col("file_path")) if enriched else F.col("content")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                counts = [term_counts(t) for t in part.column(1).to_pylist()]
                off = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in counts])]), pa.int32())
                terms = pa.ListArray.from_arrays(off, pa.array([t for c in counts for t in c], pa.string()))
                tfs = pa.ListArray.from_arrays(off, pa.array([n for c in counts for n in c.values()], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sum(c.values()) for c in counts], pa.int64()), terms, tfs], ["chunk_id", "dl", "terms", "tfs"])

    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), text.alias("text")).mapInArrow(run, "chunk_id long, dl long, terms array<string>, tfs array<int>")


def build(counted: DataFrame, wanted: DataFrame | None = None) -> Postings:
    """The index of :func:`chunk_terms`, which have each chunk's counts already, so postings need no shuffle.

    All three tables read ``counted``: as a work table, texts are read once. With ``wanted(term)`` only those terms are
    indexed: what queries that are known beforehand need doesn't shuffle all postings. The statistics of the corpus are those of all terms.
    """
    postings = counted.select("chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), "chunk_id", F.col("p.tfs").alias("tf"), "dl")
    if wanted is not None:
        postings = postings.join(wanted.select("term").distinct(), "term", "left_semi")
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    n = F.count("*")
    corpus = counted.agg(n.alias("n"), F.when(n > 0, F.sum("dl") / n).otherwise(0.0).cast("double").alias("avgdl"))
    return Postings(postings, terms, corpus, counted)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, pos, term)``: the distinct tokens of each query text in order."""
    return queries.select("query_id", F.posexplode(unique_tokens(F.col("text"))).alias("pos", "term"))


def contributions(index: Postings, terms: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, pos, contrib)``: what every query term adds to a chunk."""
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(index.terms, "term").crossJoin(F.broadcast(index.corpus)).select("query_id", "pos", "term", idf.alias("idf"), F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl")).alias("avgdl"))
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    denom = tf + K1 * (1 - B + B * dl / F.col("avgdl"))
    contrib = F.col("idf") * tf * (K1 + 1) / F.when(denom == 0, 1.0).otherwise(denom)
    return index.postings.join(weights, "term").select("query_id", "chunk_id", "pos", contrib.alias("contrib"))


def scores(index: Postings, queries: DataFrame, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``(query_id, chunk_id, score)`` of every chunk with a query term.

    Single-precision sums in the order of the query's terms, so that ties are the same
    wherever the rows come from. With chunks' counts the scores are added up where these are, for a block of queries at a time, and nothing
    is shuffled; postings, and queries that share an id, are joined.
    """
    queries = queries.select("query_id", "text")
    if index.counted is None or queries.groupBy("query_id").count().filter("count > 1").first():
        return _joined(index, queries)
    out = None
    for shared in _blocks(index, queries, query_bytes):

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids = pa.array([q for q, _ in shared.value[0]], pa.int64())
            for part in _slices(it):
                cid, held, size = part.column(0).to_numpy(), [], 0
                for q, total in _totals(part, shared.value):
                    # a term adds more than 0, so these are all chunks that have one
                    y = np.flatnonzero(total > 0)
                    if len(y):
                        held.append((q, y, total[y]))
                        size += len(y)
                    if size >= MOST:
                        yield _pairs(ids, cid, held)
                        held, size = [], 0
                if held:
                    yield _pairs(ids, cid, held)

        part = index.counted.select("chunk_id", "dl", "terms", "tfs").mapInArrow(run, _SCORES)
        out = part if out is None else out.union(part)
    return index.counted.sparkSession.createDataFrame([], _SCORES) if out is None else out


_SCORES = "query_id long, chunk_id long, score float"


def _joined(index: Postings, queries: DataFrame) -> DataFrame:
    hits = contributions(index, query_terms(queries)).groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "contrib"))).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0).cast("float"), lambda a, x: (a.cast("double") + x["contrib"]).cast("float"))
    return hits.select("query_id", "chunk_id", total.alias("score"))


def _pairs(ids: pa.Array, cid: np.ndarray, held: list) -> pa.RecordBatch:
    at = np.repeat([q for q, _, _ in held], [len(y) for _, y, _ in held])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(cid[np.concatenate([y for _, y, _ in held])]), pa.array(np.concatenate([x for _, _, x in held]))], ["query_id", "chunk_id", "score"])


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for lo in range(0, b.num_rows, SLICE):
            yield b.slice(lo, SLICE)


def _totals(part: pa.RecordBatch, value: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """Every query's place and its scores of all chunks of ``part(chunk_id, dl, terms, tfs)``."""
    asked, vocabulary, idf, avgdl = value[:4]
    dl = part.column(1).to_numpy().astype(float)
    size = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
    term = pc.fill_null(pc.index_in(part.column(2).flatten(), value_set=vocabulary), -1).to_numpy()
    hit = np.flatnonzero(term >= 0)
    row = np.repeat(np.arange(len(dl)), size)[hit]
    tf, term = part.column(3).flatten().to_numpy()[hit].astype(float), term[hit]
    denom = tf + K1 * (1 - B + B * dl[row] / avgdl)
    add = idf[term] * tf * (K1 + 1) / np.where(denom == 0, 1.0, denom)
    order = np.argsort(term, kind="stable")
    row, add = row[order], add[order]
    to = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
    for q, (_, terms) in enumerate(asked):
        total = np.zeros(len(dl), np.float32)
        for t in terms[to[terms + 1] > to[terms]]:
            x = row[to[t] : to[t + 1]]
            total[x] = (total[x].astype(float) + add[to[t] : to[t + 1]]).astype(np.float32)
        yield q, total


def _blocks(index: Postings, queries: DataFrame, query_bytes: int) -> Iterator:
    """For each block of queries what :func:`_totals` needs, sent to the workers, and the filters of ``queries`` that have some."""
    spark = index.counted.sparkSession
    ship(spark)
    stats = index.corpus.first()
    for block in in_blocks(queries, lambda r: 2 * len(r.text or "") + 64, query_bytes):
        own = [ordered_terms(r.text) for r in block]
        vocabulary = pa.array(sorted({t for x in own for t in x}), pa.string())
        df = _frequencies(index.counted, vocabulary)
        at = {t: i for i, t in enumerate(vocabulary.to_pylist())}
        idf = np.log(1.0 + (stats.n - df + 0.5) / (df + 0.5))
        asked = [(r.query_id, np.array([at[t] for t in x], np.int64)) for r, x in zip(block, own)]
        place: dict[int, list[int]] = {}
        for i, r in enumerate(block):
            place.setdefault(r.query_id, []).append(i)
        kinds = [(langs, parts, {i for q in ids for i in place[q]}) for langs, parts, ids in filter_kinds(block)] if "filter_paths" in queries.columns else []
        yield spark.sparkContext.broadcast((asked, vocabulary, idf, stats.avgdl or 1.0, kinds))


def top_k(scored: DataFrame, k, rank: str = "rank") -> DataFrame:
    """The ``k`` best positive scores of each query, ties by chunk; ``k`` is a number or a column."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.filter("score > 0").withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _frequencies(counted: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """The number of chunks that have each term; counts combine before the shuffle."""
    shared = counted.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for part in _slices(it):
            at = pc.index_in(part.column(0).flatten(), value_set=shared.value).drop_null()
            total += np.bincount(at.to_numpy(), minlength=len(total))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], ["t", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in counted.select("terms").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[r.t] = r.n
    return out


def best(index: Postings, queries: DataFrame, k: int, rank: str = "rank", chunks: DataFrame | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """:func:`top_k` of :func:`scores` for a table of queries, chunk by chunk.

    Queries go to the chunks in blocks of ``query_bytes`` of text, of which the driver holds one at a time. Every task adds up the terms of
    its chunks for all queries of a block, in the order of the query, and keeps ``k`` chunks a query, so what is shuffled doesn't grow with the
    pairs of queries and chunks. With ``chunks(chunk_id, file_path, language)`` the queries' filters apply before the cut. An index without
    chunks' counts is searched by its postings.
    """
    if index.counted is None:
        return top_k(scores(index, queries) if chunks is None else passing(scores(index, queries), queries, chunks), k, rank)
    filters = ["filter_languages", "filter_paths"] if chunks is not None else []
    rows = index.counted.select("chunk_id", "dl", "terms", "tfs")
    if chunks is not None:
        rows = rows.join(chunks.select(F.col("chunk_id").alias("of_chunk"), "file_path", "language"), F.col("chunk_id") == F.col("of_chunk")).drop("of_chunk")
    hits = None
    for shared in _blocks(index, queries.select("query_id", "text", *filters), query_bytes):

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, kinds = shared.value[0], shared.value[4]
            found = [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(asked)
            for part in _slices(it):
                cid = part.column(0).to_numpy()
                masks = [(mask(part.column(5), part.column(4), langs, parts), own) for langs, parts, own in kinds]
                for q, total in _totals(part, shared.value):
                    for ok, own in masks:
                        if q in own:
                            total[~ok] = 0
                    ids, score = found[q]
                    y = np.flatnonzero((total > 0) & (total >= (score[-1] if len(score) >= k else 0)))
                    if len(y):
                        ids, score = np.r_[ids, cid[y]], np.r_[score, total[y]]
                        first = np.lexsort((ids, -score))[:k]
                        found[q] = ids[first], score[first]
            n = [len(ids) for ids, _ in found]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _ in asked], n)), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([x for _, x in found]))], ["query_id", "chunk_id", "score"])

        part = rows.mapInArrow(run, _SCORES)
        hits = part if hits is None else hits.union(part)
    if hits is None:
        hits = index.counted.sparkSession.createDataFrame([], _SCORES)
    return top_k(hits, k, rank)

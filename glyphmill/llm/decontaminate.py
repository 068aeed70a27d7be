"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, binary, prepare, texts, unused
from .textvec import U, distinct, grams, signed, words

#: The shortest tile, in words; the share of a passage that tiles must cover.
MIN_MATCH, COVERAGE = 5, 0.5
#: Bytes up to which the benchmark's index is broadcast. It takes 32 bytes a word and 1 MiB, so 16 bytes a character at most.
INDEX_BYTES = 128 << 20
OUT = "doc_id long, item_id long, coverage double, tiles int, words int"


def tiling(i: np.ndarray, j: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from matching seeds: tiles (i, j, length), longest first.

    ``i`` and ``j`` are the positions at which ``seed`` words agree. Seeds in a
    row on a diagonal are one maximal match. The longest match whose words are
    all free becomes a tile (ties: smallest j, then i); a match that loses words
    to a tile stays with its free runs of at least ``seed`` words.
    """
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    cut = np.flatnonzero((np.diff(i - j) != 0) | (np.diff(i) != 1)) + 1
    heap = [(-int(b - a + seed - 1), int(j[a]), int(i[a])) for a, b in zip(np.r_[0, cut], np.r_[cut, len(i)])]
    heapq.heapify(heap)
    used_i: set[int] = set()
    used_j: set[int] = set()
    out = []
    while heap:
        n, q, p = heapq.heappop(heap)
        n = -n
        free = [p + k not in used_i and q + k not in used_j for k in range(n)]
        if all(free):
            out.append((p, q, n))
            used_i.update(range(p, p + n))
            used_j.update(range(q, q + n))
            continue
        k = 0
        while k < n:
            if free[k]:
                e = k
                while e < n and free[e]:
                    e += 1
                if e - k >= seed:
                    heapq.heappush(heap, (-(e - k), q + k, p + k))
                k = e
            k += 1
    return out


class Index:
    """The seeds of some passages: a bit table, then sorted hashes with item and position."""

    def __init__(self, ids: list[int], h: np.ndarray, off: np.ndarray, seed: int):
        g, to = grams(h, off, seed)
        item = np.repeat(np.arange(len(off) - 1), np.diff(to))
        pos = np.arange(len(g)) - to[item]
        order = np.argsort(g, kind="stable")
        self.seed, self.ids, self.h, self.off = seed, ids, h, off
        self.g, self.item, self.pos = g[order], item[order], pos[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[g >> U(44)] = True

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in g, position in the index) of all equal seeds."""
        at = np.flatnonzero(self.bits[g >> U(44)])
        lo, hi = (np.searchsorted(self.g, g[at], side=s) for s in ("left", "right"))
        n = hi - lo
        keep = n > 0
        at, lo, n = at[keep], lo[keep], n[keep]
        return np.repeat(at, n), np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())


def contaminated(index: Index, arr: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, coverage, tiles, words) at or above the threshold."""
    w = words(arr)
    g, to = grams(w.hashes, w.off, index.seed)
    at, hit = index.hits(g)
    if not len(at):
        return
    row = np.searchsorted(to, at, side="right") - 1
    # where g starts in the words: rows shorter than a seed have none
    i = at - to[row] + w.off[row]
    item, j = index.item[hit], index.pos[hit]
    same = np.ones(len(i), bool)  # Karp-Rabin: compare the words themselves
    for k in range(index.seed):
        same &= w.hashes[i + k] == index.h[index.off[item] + j + k]
    row, item, i, j = row[same], item[same], i[same], j[same]
    order = np.lexsort((item, row))
    row, item, i, j = row[order], item[order], i[order], j[order]
    cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(row)]):
        if a == b:
            continue
        size = int(index.off[item[a] + 1] - index.off[item[a]])
        starts = np.unique(j[a:b])  # the most that tiles could cover
        if np.minimum(np.diff(starts, append=starts[-1] + index.seed), index.seed).sum() < threshold * size:
            continue
        found = tiling(i[a:b], j[a:b], index.seed)
        n = sum(x[2] for x in found)
        if n >= threshold * size:
            yield int(row[a]), int(item[a]), n / size, len(found), n


def passages(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(bench, id_col, text_col).filter("doc_id is not null")


def small_index(bench: DataFrame, seed: int, limit: int) -> Index | None:
    """The index of a benchmark, if it can't take more than ``limit`` bytes."""
    if 16 * (bench.agg(F.sum(F.length("text"))).first()[0] or 0) + (1 << 20) > limit:
        return None
    rows = sorted((r.doc_id, r.text) for r in bench.collect())
    w = words(pa.array([t for _, t in rows], pa.string()))
    return Index([i for i, _ in rows], w.hashes, w.off, seed)


def contamination(docs: DataFrame, bench: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``(doc_id, item_id, coverage, tiles, words)`` of documents that hold benchmark passages.

    ``coverage`` is the share of the passage's words under tiles of at least
    ``min_match`` words, wherever and in whatever order they stand in the document.

    A benchmark whose index takes at most ``index_bytes`` is broadcast,
    and documents are tiled where they are read, without a shuffle. A larger one is
    joined to the documents by seed hash, and pairs whose shared seeds could reach
    the threshold are brought together and tiled: the same rows.

    Passages of fewer than ``min_match`` words can't be found. Null or empty texts
    match nothing; rows with a null id are left out; repeated rows are each reported;
    empty tables give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    d, b = texts(docs, id_col, text_col).filter("doc_id is not null"), passages(bench, item_col, item_text)
    index = small_index(b, min_match, index_bytes)
    if index is None:
        return by_shuffle(d, b, min_match, coverage)
    shared = spark.sparkContext.broadcast(index)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for x in batches(it):
            got = [(row, ix.ids[item], round(c, 6), t, n) for row, item, c, t, n in contaminated(ix, x.column(1), coverage)]
            if got:
                row, *rest = zip(*got)
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(row)), *(pa.array(v, k) for v, k in zip(rest, (pa.int64(), pa.float64(), pa.int32(), pa.int32())))], ["doc_id", "item_id", "coverage", "tiles", "words"])

    return d.mapInArrow(run, OUT)


def reached(row: np.ndarray, pos: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """The words of each row's item that seeds at ``pos`` cover: the most that tiles could."""
    order = np.lexsort((pos, row))
    row, pos = row[order], pos[order]
    step = np.full(len(pos), seed)
    inside = row[1:] == row[:-1]
    step[:-1][inside] = np.minimum(np.diff(pos)[inside], seed)
    return np.bincount(row, step, rows).astype(np.int64)


def by_shuffle(d: DataFrame, b: DataFrame, seed: int, coverage: float) -> DataFrame:
    """Contamination for a benchmark of any size. Texts are joined by their hashes, and each row is tiled by its own."""

    def seeds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches(it):
            w = words(x.column(1))
            g, to = distinct(*grams(w.hashes, w.off, seed))
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(np.repeat(np.arange(x.num_rows), np.diff(to)))), pa.array(signed(g))], ["tkey", "h"])

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches(it):
            w = words(x.column(1))
            g, to = grams(w.hashes, w.off, seed)
            at = np.repeat(np.arange(x.num_rows), np.diff(to))
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(at)), pa.array(signed(g)), pa.array(np.arange(len(g)) - to[at]), pa.array(np.diff(w.off)[at])], ["ikey", "h", "pos", "n"])

    def likely(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            size, at = x.column(2).to_numpy(), x.column(3)
            row = np.repeat(np.arange(x.num_rows), at.value_lengths().to_numpy(zero_copy_only=False))
            most = reached(row, at.flatten().to_numpy(), x.num_rows, seed)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["tkey", "ikey"]).filter(pa.array(most >= coverage * size))

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches(it):
            w = words(x.column(1))
            yield pa.RecordBatch.from_arrays([x.column(0), binary(w.hashes, w.off), x.column(2)], ["id", "w", "key"])

    d, b = (t.withColumn("key", F.xxhash64("text")) for t in (d, b))
    sd = d.select("key", "text").mapInArrow(seeds, "tkey long, h long")
    sb = b.select("key", "text").mapInArrow(places, "ikey long, h long, pos long, n long")
    pairs = sd.join(sb, "h").groupBy("tkey", "ikey", "n").agg(F.collect_set("pos").alias("at")).mapInArrow(likely, "tkey long, ikey long")
    kind = d.schema["doc_id"].dataType.simpleString()
    left, right = d.select("doc_id", "text", "key").mapInArrow(hashed, f"id {kind}, w binary, key long"), b.mapInArrow(hashed, "id long, w binary, key long")
    both = pairs.join(left.select(F.col("id").alias("doc_id"), F.col("w").alias("dw"), F.col("key").alias("tkey")), "tkey").join(right.select(F.col("id").alias("item_id"), F.col("w").alias("iw"), F.col("key").alias("ikey")), "ikey")

    def tile(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            out = []
            for doc, item, dw, iw in zip(*(x.column(k).to_pylist() for k in range(4))):
                p, q = np.frombuffer(dw, U), np.frombuffer(iw, U)
                ix = Index([item], q, np.array([0, len(q)]), seed)
                g, _ = grams(p, np.array([0, len(p)]), seed)
                i, hit = ix.hits(g)
                found = tiling(i, ix.pos[hit], seed) if len(i) else []
                n = sum(t[2] for t in found)
                if found and n >= coverage * len(q):
                    out.append((doc, item, round(n / len(q), 6), len(found), n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), (x.schema.field(0).type, pa.int64(), pa.float64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "coverage", "tiles", "words"])

    return both.select("doc_id", "item_id", "dw", "iw").mapInArrow(tile, OUT.replace("long", kind, 1))


def decontaminate(docs: DataFrame, bench: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark passage.

    Every row is judged by its own text, also one with a null id, whatever the size of the benchmark: repeated rows stay or go
    together, and texts that differ under one id are judged apart. Null, empty and wordless texts stay; texts are read whole. An empty benchmark, or
    one of null and too short passages, keeps all rows; an empty table stays empty. Other columns may have any name.
    """
    spark = docs.sparkSession
    prepare(spark)
    b = passages(bench, item_col, item_text)
    index = small_index(b, min_match, index_bytes)
    if index is None:
        # a text is known by its digest, so the ids play no part
        digest = lambda text: F.unhex(F.sha2(text, 256))
        (name,) = unused(docs, "bad")
        d = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).distinct()
        bad = by_shuffle(d.select(digest(F.col("text")).alias("doc_id"), "text"), b, min_match, coverage).select(F.col("doc_id").alias(name)).distinct()
        return docs.join(bad, digest(docs[text_col].cast("string")) == bad[name], "left_anti")
    shared = spark.sparkContext.broadcast(index)
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches(it, text_col):
            keep = np.ones(x.num_rows, bool)
            keep[[r[0] for r in contaminated(shared.value, x.column(at), coverage)]] = False
            yield x.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

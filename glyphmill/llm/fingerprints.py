"""Lempel-Ziv fingerprints: minimum-hash signatures of the phrases of a dictionary parse."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import classes, found_links, meeting, tiled
from .common import batches, binary, prepare, stash, texts, unbinary
from .ngram_join import SHIFT, SLOTS, packed_counts, ranks
from .textvec import U, mix, row_reduce, signed, words

#: Hashes in a signature, and the least similarity of a link.
HASHES, THRESHOLD = 128, 0.5
#: Bands of a signature with the hashes in each, for :func:`band_keys`; :func:`similar_classes` doesn't use bands.
BANDS, BAND = 64, 4
TILE = 1024
MASK = (1 << 61) - 1
TOP = U(0xFFFFFFFF)


def phrases(symbols: list[int]) -> list[int]:
    """Hashes of the phrases of the LZ78 parse: each is a known one and one more symbol.

    A rest at the end that is a known phrase adds nothing.
    """
    known: set[int] = set()
    add = known.add
    out = []
    node = 0
    for s in symbols:
        node = (node * 0x9E3779B97F4A7C1 + s + 1) & MASK
        if node not in known:
            add(node)
            out.append(node)
            node = 0
    return out


def signatures(arr: pa.Array, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of phrases, signature) of each text, with words as symbols.

    A signature has the 32 bits of every minimum in four planes of bytes, the lowest
    first, 0 taken as 1 in that one. So its first plane is a sketch, of which 0 is no byte.
    """
    w = words(arr)
    symbols = (w.hashes >> U(3)).tolist()
    parts = [phrases(symbols[a:b]) for a, b in zip(w.off, w.off[1:])]
    n = np.array([len(p) for p in parts], np.int64)
    to = np.concatenate([[0], np.cumsum(n)])
    flat = mix(np.fromiter((x for p in parts for x in p), U, int(to[-1])))
    sig = np.empty((len(arr), 4 * hashes), np.uint8)
    for k in range(hashes):
        m = flat * U((0xD1342543DE82EF95 * (2 * k + 1) ^ 0x5851F42D4C957F2C) & (1 << 64) - 1 | 1)
        low = row_reduce(np.minimum, m >> U(32), to, TOP)
        sig[:, k] = np.maximum((low & U(0xFF)).astype(np.uint8), 1)
        for plane in (1, 2, 3):
            sig[:, plane * hashes + k] = (low >> U(8 * plane) & U(0xFF)).astype(np.uint8)
    return n, sig


def joined(sig: np.ndarray) -> np.ndarray:
    """The planes of signatures as one array of 32-bit numbers."""
    own = sig.reshape(len(sig), 4, -1).astype(np.uint32)
    return own[:, 0] | own[:, 1] << 8 | own[:, 2] << 16 | own[:, 3] << 24


def band_keys(sig: np.ndarray, bands: int, band: int) -> np.ndarray:
    """The key of every band of signatures of 32-bit numbers. Bands go through all hashes, then again in other orders."""
    n = sig.shape[1]
    walks = [(np.arange(n) * step + (step > 1)) % n for step in (1, 2 * n // 5 | 1, 2 * n // 7 | 1, 2 * n // 9 | 1)]
    order = np.concatenate([w[: n // band * band] for w in walks]).reshape(-1, band)
    if bands > len(order):
        raise ValueError(f"at most {len(order)} bands")
    out = np.empty((len(sig), bands), np.int64)
    for k in range(bands):
        h = np.full(len(sig), U(k + 1))
        for p in order[k]:
            h = mix(h * U(0x9FB21C651E98DF25) + sig[:, p].astype(U))
        out[:, k] = h.view(np.int64)
    return out


def places(sig: np.ndarray) -> np.ndarray:
    """A hash of each place of signatures of 32-bit numbers, with what is there."""
    return mix(sig.astype(U) + (np.arange(sig.shape[1], dtype=U) << U(32)))


def prefix_keys(sig: np.ndarray, least: float, order: np.ndarray) -> np.ndarray:
    """The keys of signatures of 32-bit numbers, of which all that agree in ``least`` places share one.

    In one order of all places and their numbers, the rare ones first, a signature's keys are its first ones: as many as there
    are places, less ``least``, and one. What is common to two and first of it in that order is a key of both.
    """
    n = sig.shape[1]
    own = places(sig)
    rank = order[(own >> SHIFT).astype(np.int64)].astype(U) << U(56) | own >> U(8)
    first = np.argsort(rank, axis=1)[:, : max(n - math.ceil(least - 1e-9) + 1, 1)]
    return signed(np.take_along_axis(own, first, axis=1))


def agreeing(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a left and a right row that agree in ``least`` places, each once; the same rows on both sides are paired within."""
    within = left is right
    r = np.ascontiguousarray(sig[right])
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, x in enumerate(left):
        own = r[k + 1 :] if within else r
        y = np.flatnonzero((own == sig[x]).sum(1) >= least - 1e-9)
        xs.append(np.full(len(y), x))
        ys.append(right[y + k + 1 if within else y])
    return np.concatenate(xs), np.concatenate(ys)


def fingerprints(docs: DataFrame, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, phrases, signature)`` of every row: the number of phrases, and the minima of ``hashes`` hashes by :func:`signatures`.

    Null, empty and wordless texts have no phrases and a signature of ones; a null
    id stays null; repeated rows have equal fingerprints; an empty table gives none.
    Texts are parsed whole.
    """
    prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            n, sig = signatures(b.column(1), hashes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), binary(sig.ravel(), np.arange(len(n) + 1) * 4 * hashes)], ["doc_id", "phrases", "signature"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, phrases long, signature binary")


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, hashes: int = HASHES, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, links)`` of every document: its class of similar documents, and how many it is similar to.

    Documents are similar if their signatures agree in a share of ``threshold``. A class is what
    links connect, directly or through others; ``class_id`` is the least id in it. ``links`` counts
    all other documents that are similar to this one, each copy too, but copies are not expanded into pairs.

    Every document is a query, and no link is missed: signatures that agree in the share share a key by
    :func:`prefix_keys`, whatever the order; its frequencies only make keys rare. Signatures that share a key and could agree
    by the lowest bytes of their numbers are linked; what links connect is one component, in which all are
    compared, in pairs of tiles of about ``tile``.

    Texts without words, null and empty ones are a class of their own without links; rows with a null id are left
    out; repeated rows count once, and different texts under one id are documents of their own, with
    a row each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        for b in batches(it):
            n, sig = signatures(b.column(1), hashes)
            np.add.at(counts, (places(joined(sig)[n > 0]) >> SHIFT).astype(np.int64).ravel(), 1)
            col = binary(sig.ravel(), np.arange(len(n) + 1) * 4 * hashes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), col], names)
        used, parts = packed_counts(counts)
        if used:  # rows without an id
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.array(used, pa.int64()), pa.array(parts, pa.binary())], names)

    names = ["doc_id", "n", "sig"]
    d = texts(docs, id_col, text_col).filter("doc_id is not null")
    # the rows of counters have their slice for sid
    sid = F.when(F.col("doc_id").isNull(), F.col("n")).when(F.col("n") > 0, F.xxhash64("sig"))
    base = stash(d.mapInArrow(run, "doc_id long, n long, sig binary").select("doc_id", sid.alias("sid"), F.when(F.col("doc_id").isNull() | (F.col("n") > 0), F.col("sig")).alias("sig")), "fingerprints")
    order = spark.sparkContext.broadcast(ranks(base.filter("doc_id is null").select("sid", F.col("sig").alias("sketch"))))
    base = base.filter("doc_id is not null")
    own = base.filter("sid is not null")
    # partial counts of small rows; signatures are moved once, and only those of components
    count = own.select("sid", "doc_id").distinct().groupBy("sid")
    rep = stash(count.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("w")), "sets")

    def keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = unbinary(b.column(1), np.uint8)[0].reshape(b.num_rows, -1)
        got = prefix_keys(joined(flat), threshold * hashes, order.value)
        return np.repeat(np.arange(b.num_rows), got.shape[1]), got.ravel(), flat[:, :hashes]

    comps = meeting(own.select("sid", "sig"), keys, None, hashes, threshold)
    members = rep.join(comps.hint("merge"), F.col("sid") == F.col("node")).select("comp", "sid", "w", F.col("doc_id").alias("of_id"))
    place = tiled(members, tile).withColumnRenamed("sid", "of_sid")
    sets = own.join(place.hint("merge"), (F.col("sid") == F.col("of_sid")) & (F.col("doc_id") == F.col("of_id"))).select("comp", "sid", "w", "tile", "last", "sig")

    def hits(t: pa.Table, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, _ = unbinary(t.column("sig").combine_chunks() if t.column("sig").num_chunks != 1 else t.column("sig").chunk(0), np.uint8)
        return agreeing(joined(flat.reshape(-1, 4 * hashes)), left, right, threshold * hashes)

    found = stash(found_links(sets, "sig", hits, most=2048), "found")
    return classes(base.select("doc_id", "sid"), rep, found)

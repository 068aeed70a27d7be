"""N-gram Jaccard join: a self-join of documents by a prefix tree over their n-gram sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import classes, found_links, meeting, tiled
from .common import batches, binary, prepare, stash, texts, unbinary, unused
from .textvec import U, distinct, grams, mix, row_reduce, signed, words

#: Words in a gram, and the least Jaccard similarity of a pair.
N, THRESHOLD = 3, 0.5
#: Random orders of the grams. Two sets of similarity J meet under an order with probability J * J at least.
ORDERS = 32
#: The most sets in a tile: trees and matrices are for a tile at a time.
TILE = 1024
MATRIX = 64 << 20
#: Bytes of a sketch, and the share of them that must agree for a link. At similarity 0.5 about 0.5 do.
SKETCH, LINK = 128, 0.34
#: Counters of the grams' frequencies, which give the global order, and those of a slice that a task sends.
SLOTS, SLICE = 1 << 20, 1 << 16
SHIFT = U(44)


def gram_sets(arr: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct n-gram hashes of each text. One to n - 1 words are one gram."""
    w = words(arr)
    g, to = grams(w.hashes, w.off, n)
    size = np.diff(w.off)
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        extra = np.zeros(len(few), U)
        for k in range(1, n):
            own = size[few] == k
            if own.any():
                extra[own] = grams(w.hashes, w.off, k)[0][np.searchsorted(np.repeat(np.arange(len(size)), np.maximum(size - k + 1, 0)), few[own])]
        g, to = np.insert(g, to[few], extra), to + np.searchsorted(few, np.arange(len(to)))
    return distinct(g, to)


def signatures(arr: pa.Array, n: int, orders: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set id, size, keys, the keys' offsets, sketch) of each text; ``counts`` gets all grams.

    A key is the node of depth two that a set has in the tree of one order; sets of one and two grams
    have their grams as keys too. The sketch has a byte of the least gram of each of its parts of all possible hashes.
    """
    g, to = gram_sets(arr, n)
    size = np.diff(to)
    np.add.at(counts, (g >> SHIFT).astype(np.int64), 1)
    row = np.repeat(np.arange(len(to) - 1), size)
    sid = mix(row_reduce(np.add, mix(g ^ U(0x5851F42D4C957F2D)), to, U(0)) + size.astype(U))
    keys = np.zeros((len(to) - 1, orders), U)
    top = U(0xFFFFFFFFFFFFFFFF)
    for o in range(orders):
        m = g * U(0xD1342543DE82EF95 + 2 * o * 0x2545F4914F6CDD1D & (1 << 64) - 1)
        m ^= m >> U(32)
        m *= U(0x9E3779B97F4A7C15)
        first = row_reduce(np.minimum, m, to, top)
        m[m == first[row]] = top
        keys[:, o] = mix(first + U(o)) + row_reduce(np.minimum, m, to, top) * U(3)
    few = np.flatnonzero((size == 1) | (size == 2))
    own = np.repeat(to[:-1][few], size[few]) + np.arange(size[few].sum()) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
    many = np.full(len(size), orders)
    many[few] += size[few]
    at = np.concatenate([[0], np.cumsum(many)])
    flat = np.zeros(at[-1], U)
    flat[(at[:-1, None] + np.arange(orders)).ravel()] = keys.ravel()
    flat[np.repeat(at[:-1][few] + orders, size[few]) + np.arange(len(own)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])] = mix(g[own])
    sketch = np.zeros((len(to) - 1, SKETCH), np.uint8)
    spread = mix(g)
    part = (spread >> U(57)).astype(np.int64)
    order = np.lexsort((spread, row))
    place = row[order] * SKETCH + part[order]
    least = order[np.r_[True, place[1:] != place[:-1]]] if len(place) else order
    sketch.ravel()[row[least] * SKETCH + part[least]] = np.maximum((spread[least] & U(0xFF)).astype(np.uint8), 1)
    return sid, size, flat, at, sketch


def packed_counts(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The numbers of the slices of a task's counters that have any, and these slices, compressed."""
    used = [s for s in range(SLOTS // SLICE) if counts[s * SLICE : (s + 1) * SLICE].any()]
    return used, [zlib.compress(counts[s * SLICE : (s + 1) * SLICE].tobytes(), 1) for s in used]


def ranks(counted: DataFrame) -> np.ndarray:
    """A frequency class, 0 to 255, for every counter: eight to a doubling. ``counted`` has the tasks' slices.

    The slices are summed where they are, and a byte for each of SLOTS counters comes to the driver.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in it:
            for s, data in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(zlib.decompress(data.as_py()), np.uint32).astype(np.int64)
                total[s] = total[s] + part if s in total else part
        for s, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.minimum(8 * np.log2(t + 1), 255).astype(np.uint8).tobytes()], pa.binary())], ["s", "c"])

    out = np.zeros(SLOTS, np.uint8)
    for r in counted.repartition("sid").mapInArrow(run, "s long, c binary").collect():
        out[r.s * SLICE : (r.s + 1) * SLICE] = np.frombuffer(r.c, np.uint8)
    return out


def trie_join(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, t: float, classes: np.ndarray) -> list[tuple[int, int, int]]:
    """(x, y, overlap) of the pairs of a left and a right set with Jaccard similarity ``t``, each once.

    The right sets are put in a compressed prefix tree, in the one order that holds for all trees: grams of the
    highest frequency class first, of one class the lower hash. The tree is walked once for a block of left sets: a node adds
    to the vector of overlaps that it inherits, so all sets below share it. A left
    set is dropped from a subtree when even all grams that remain on either side
    can't make its overlap large enough for any size below.
    """
    size = np.array([len(s) for s in sets])
    members = np.unique(np.r_[left, right])
    cat, inv = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
    rank = np.empty(len(cat), np.int64)
    rank[np.lexsort((cat, -classes[(cat >> SHIFT).astype(np.int64)].astype(np.int64)))] = np.arange(len(cat))
    off = np.concatenate([[0], np.cumsum(size[members])])
    own = {int(i): np.sort(rank[inv[off[k] : off[k + 1]]]) for k, i in enumerate(members)}
    order = sorted((int(i) for i in right), key=lambda i: own[i].astype(">u4").tobytes())
    rows = [own[i] for i in order]
    n_right = size[order]
    out = []
    share = t / (1 + t)
    at = 0
    left = np.asarray(left)
    while at < len(left):
        total, to = 0, at
        while to < len(left) and to - at < 256 and (to == at or (total + size[left[to]]) * (to - at + 1) <= MATRIX):
            total += size[left[to]]
            to += 1
        probe = left[at:to]
        at = to
        held = np.unique(np.concatenate([own[int(i)] for i in probe]))
        has = np.zeros((len(held) + 1, len(probe)), np.uint8)  # the last row: grams of no probe
        for c, i in enumerate(probe):
            has[np.searchsorted(held, own[int(i)]), c] = 1
        where = np.full(len(cat), len(held))
        where[held] = np.arange(len(held))
        nx = size[probe]
        stack = [(0, len(rows), 0, np.zeros(len(probe), np.int64), np.arange(len(probe)))]
        while stack:
            lo, hi, d, o, act = stack.pop()
            a, b = rows[lo], rows[hi - 1]
            m = min(len(a), len(b))
            diff = np.flatnonzero(a[d:m] != b[d:m])
            e = d + int(diff[0]) if len(diff) else m
            if e > d:
                edge = where[a[d:e]]
                edge = edge[edge < len(held)]
                if len(edge):
                    part = has[edge] if len(act) == len(probe) else has[edge[:, None], act]
                    o = o + part.sum(0, dtype=np.int64)
            mn, mx = n_right[lo:hi].min(), n_right[lo:hi].max()
            ok = (o + mx - e >= share * (nx[act] + mx) - 1e-9) & (nx[act] >= share * (nx[act] + mn) - 1e-9)
            if not ok.all():
                o, act = o[ok], act[ok]
            if not len(act):
                continue
            while lo < hi and len(rows[lo]) == e:  # sets that end here
                y = order[lo]
                hit = np.flatnonzero((o >= t * (nx[act] + e - o) - 1e-9) & (probe[act] != y))
                out += [(int(probe[act[k]]), y, int(o[k])) for k in hit]
                lo += 1
            if lo < hi:
                nxt = np.fromiter((r[e] for r in rows[lo:hi]), np.int64, hi - lo)
                cuts = np.flatnonzero(np.diff(nxt)) + 1
                stack += [(lo + int(p), lo + int(q), e, o, act) for p, q in zip(np.r_[0, cuts], np.r_[cuts, hi - lo])]
    return out


def prepared(docs: DataFrame, n: int, threshold: float, orders: int, tile: int, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``(doc_id, class_id, links)`` of every document, and ``more``: ``tkey`` is the hash of its text."""
    spark = docs.sparkSession
    prepare(spark)

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "tkey", "sid", "keys", "sketch"]
        counts = np.zeros(SLOTS, np.uint32)
        for b in batches(it):
            sid, size, keys, at, sketch = signatures(b.column(1), n, orders, counts)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(keys)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(signed(sid), mask=size == 0), lists, binary(sketch.ravel(), np.arange(len(sid) + 1) * SKETCH)], names)
        # the task's counters, in slices, as rows without an id
        used, packed = packed_counts(counts)
        if used:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.array(used, pa.int64()), pa.nulls(len(used), pa.list_(pa.int64())), pa.array(packed, pa.binary())], names)

    d = texts(docs, id_col, text_col).filter("doc_id is not null").withColumn("tkey", F.xxhash64("text"))
    base = stash(d.mapInArrow(sign, "doc_id long, tkey long, sid long, keys array<long>, sketch binary"), "signatures")
    order = spark.sparkContext.broadcast(ranks(base.filter("doc_id is null").select("sid", "sketch")))
    base = base.filter("doc_id is not null")
    own = base.filter("sid is not null")
    # partial counts of small rows; keys and sketches aren't moved with them
    parts = own.groupBy("sid", "doc_id").agg(F.min("tkey").alias("tkey"))
    rep = stash(parts.groupBy("sid").agg(F.min(F.struct("doc_id", "tkey")).alias("r"), F.count("*").alias("w")).select("sid", "r.doc_id", "r.tkey", "w"), "sets")

    def keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = b.column(1)
        row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        return row, lists.flatten().to_numpy(zero_copy_only=False), unbinary(b.column(2), np.uint8)[0].reshape(-1, SKETCH)

    comps = meeting(own.select("sid", "keys", "sketch"), keys, None, SKETCH, LINK)
    placed = rep.join(comps, F.col("sid") == F.col("node")).select("comp", "sid", "w", F.col("doc_id").alias("of_id"), F.col("tkey").alias("of_key"))
    # merged at every size: whether the ids of a small corpus could be broadcast doesn't decide the plan
    place = tiled(placed, tile)
    near = d.join(place.hint("merge"), (d["doc_id"] == place["of_id"]) & (d["tkey"] == place["of_key"]))

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            g, to = gram_sets(b.column(1), n)
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(k) for k in range(2, 6)), binary(g, to)], ["sid", "comp", "w", "tile", "last", "grams"])

    def hits(t: pa.Table, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.unique(np.r_[left, right])
        flat, off = unbinary(t.column("grams").take(pa.array(rows)).combine_chunks(), U)
        sets = [flat[a:b] for a, b in zip(off, off[1:])]
        got = trie_join(sets, np.searchsorted(rows, left), np.searchsorted(rows, right), threshold, order.value)
        x, y = np.array([p[:2] for p in got], np.int64).reshape(-1, 2).T
        if left is right:
            x, y = x[x < y], y[x < y]
        return rows[x], rows[y]

    sets = near.select("sid", "text", "comp", "w", "tile", "last").mapInArrow(build, "sid long, comp long, w long, tile int, last int, grams binary")
    found = stash(found_links(sets, "grams", hits, most=512), "found")
    return classes(base.select("doc_id", *more, "sid"), rep.select("sid", "doc_id", "w"), found)


def similar_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, orders: int = ORDERS, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, links)`` of every document: its class by similar sets of word n-grams, and how many documents it is similar to.

    Documents are similar from Jaccard similarity ``threshold`` on. A class is what links connect, directly or
    through others; ``class_id`` is the least id in it. ``links`` counts all other documents that are similar to
    this one, each copy too; documents with equal sets are compared as one, so copies are not expanded into pairs.

    Every document is a query. Sets can only be compared if they meet under one of
    ``orders`` random orders, in having the same two least grams (a node of depth two
    of that order's tree), or, of one or two grams, in sharing one: with similarity J that fails with probability
    ``(1 - J * J) ** orders`` or so, 0.01 % just at 0.5. Sets that meet must also
    have similar sketches of 128 bytes, which fails with less than 0.1 % at 0.5. Sets so linked,
    directly or through others, are one component; its links are found exactly by
    :func:`trie_join`, in pairs of tiles of about ``tile`` sets, each tree in the global order of grams.

    Texts of 1 to ``n - 1`` words are one gram; those without words, null and empty ones
    are a class of their own without links; rows with a null id are left out; repeated rows count once, and different sets
    under one id are documents of their own, with a row each; an empty table gives no rows.
    """
    return prepared(docs, n, threshold, orders, tile, id_col, text_col)


def drop_similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, orders: int = ORDERS, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which one of each class of :func:`similar_classes` stays: that of the least id.

    Rows with a null id, and those of documents without words, stay. Repeated rows are one document, that stays or
    goes with all its rows. An empty table stays empty.
    """
    gi, gk = unused(docs, "gone_id", "gone_key")
    gone = prepared(docs, n, threshold, orders, tile, id_col, text_col, "tkey").filter("doc_id <> class_id").select(F.col("doc_id").alias(gi), F.col("tkey").alias(gk)).distinct()
    key = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(gone.hint("merge"), (docs[id_col].cast("long") == gone[gi]) & (key == gone[gk]), "left_anti")


SQL = f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: {" || ' ' || ".join(f"w[i + {k}]" for k in range(N))}) END)) AS g FROM w),
k AS (SELECT g, len(g) AS n, min(doc_id) AS rep, count(*) AS w FROM s WHERE len(g) > 0 GROUP BY g),
r AS (SELECT rep, n, w, unnest(g) AS gram FROM k),
p AS (SELECT a.rep AS x, b.rep AS y, b.w AS w FROM r a JOIN r b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n, b.w HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*))),
l AS (SELECT x, sum(w) AS links FROM p GROUP BY x),
reach(x, y) AS (SELECT DISTINCT x, x FROM p UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x),
c AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x)
SELECT s.doc_id, coalesce(c.class_id, k.rep, s.doc_id) AS class_id, CAST(coalesce(l.links, 0) + coalesce(k.w - 1, 0) AS BIGINT) AS links FROM s LEFT JOIN k ON s.g = k.g LEFT JOIN c ON c.x = k.rep LEFT JOIN l ON l.x = k.rep
"""

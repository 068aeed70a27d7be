"""Self-joins of distinct items: candidate components, tiles of them, and the classes that links make.

Items that share a key and have similar sketches are linked; linked items are a component. The
items of a component are compared exactly, a pair of tiles at a time, and what comes back is one
row an item and tile pair. No step holds a group of unknown size: hot keys are handed on,
components are cut into tiles by a hash, and counts are partial.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, by_group, discard, stash, unbinary
from .graph import components
from .textvec import U, mix

#: Items of one key that are compared at once.
BLOCK = 2048
#: Blocks of a key that one task holds, and those in a tile of a key that has more.
HOT, WIDE = 64, 8
#: Items of a slice that is packed, rows that are looked at at once, and the most items of a key whose pairs are all compared.
SLICED, ROWS, FEW = 2048, 1 << 14, 256
#: Items that a task may hold, and the keys of an item, about: from these follows the number of parts.
HELD, KEYS = 500_000, 64
Hits = Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: (item, key) arrays of a batch, and its items' sketches.
Keys = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def forest(sketch: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Edges that connect all rows whose sketches agree in ``share`` of the bytes that either has.

    Breadth first: a row is compared with those that none has reached yet, so a block of
    copies takes as many comparisons as it has rows.
    """
    left, rest = np.arange(len(sketch)), sketch
    out = []
    while len(left):
        queue, left, rest = [int(left[0])], left[1:], rest[1:]
        while queue and len(left):
            x = queue.pop()
            near = agree(rest, sketch[x : x + 1], share)
            if near.any():
                out += [(x, int(y)) for y in left[near]]
                queue += left[near].tolist()
                left, rest = left[~near], rest[~near]
    return out


def whole(sketch: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Edges that connect all rows with similar sketches, of any number: every two blocks are compared, in all their rows."""
    half = max(BLOCK // 2, 1)
    starts = range(0, len(sketch), half)
    out = []
    for i in starts:
        for j in starts[i // half + 1 :] if len(starts) > 1 else [0]:
            own = np.arange(i, min(i + half, len(sketch))) if len(starts) > 1 else np.zeros(0, np.int64)
            own = np.r_[own, np.arange(j, min(j + half, len(sketch)))]
            out += [(int(own[x]), int(own[y])) for x, y in forest(sketch[own], share)]
    return out


def before_shuffle(it: Iterator[pa.RecordBatch], keys: Keys, _share: float) -> Iterator[pa.RecordBatch]:
    """``(key, sid, sketch)`` rows of items that begin with ``sid``, in slices; of equal items of a slice one.

    Every key of every item goes on: an item that is left out because a similar one has its key
    would never meet what is similar to it alone. The sketches are a dictionary's, so each is there once.
    """
    for whole in it:
        for at in range(0, whole.num_rows, SLICED):
            b = whole.slice(at, SLICED)
            sid, first = np.unique(b.column(0).to_numpy(), return_index=True)
            row, key, sketch = keys(b.take(pa.array(first)))
            own = pa.DictionaryArray.from_arrays(pa.array(row.astype(np.int32)), binary(sketch.ravel(), np.arange(len(sid) + 1) * sketch.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sid[row]), own], ["key", "sid", "sketch"])


def packed(it: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """``(part, data)`` rows of the batches of :func:`before_shuffle`, a row for each part of the keys' hashes.

    ``data`` has a slice's items of that part, each with its sketch once whatever its number of keys, and for each key 32 bits of
    its hash and the item's place. Keys of a part whose 32 bits are equal are compared in vain, no more.
    """
    for b in it:
        h = mix(b.column(0).to_numpy().view(U))
        part = (h >> U(32)).astype(np.int64) % parts
        row = b.column(2).indices.to_numpy()
        flat, _ = unbinary(b.column(2).dictionary, np.uint8)
        sketch = flat.reshape(len(b.column(2).dictionary), -1)
        sid = np.zeros(len(sketch), np.int64)
        sid[row] = b.column(1).to_numpy()
        order = np.lexsort((row, part))
        part, row, low = part[order], row[order], h.astype(np.uint32)[order]
        cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else np.zeros(1, np.int64)
        data = []
        for x, y in zip(cut, cut[1:]):
            new = np.r_[True, row[x + 1 : y] != row[x : y - 1]]
            own = row[x:y][new]
            data.append(b"".join(v.tobytes() for v in (np.array([len(own), y - x]), sid[own], sketch[own], low[x:y], (np.cumsum(new) - 1).astype(np.uint32))))
        yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array(data, pa.binary())], ["part", "data"])


def unpacked(it: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The rows ``(key, sid, sketch)``, sorted by key, of a whole part of :func:`packed`: each once, and only of keys that two items have."""
    sids, sketches, keys, items = [np.zeros(0, np.int64)], [np.zeros((0, width), np.uint8)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    base = 0
    for b in it:
        for v in b.column(1):
            data = v.as_buffer()
            n, m = (int(x) for x in np.frombuffer(data, np.int64, 2))
            at = 16 + n * (8 + width)
            sids.append(np.frombuffer(data, np.int64, n, 16))
            sketches.append(np.frombuffer(data, np.uint8, n * width, 16 + 8 * n).reshape(n, width))
            keys.append(np.frombuffer(data, np.uint32, m, at))
            items.append(np.frombuffer(data, np.uint32, m, at + 4 * m).astype(np.int64) + base)
            base += n
    sid, first, item = np.unique(np.concatenate(sids), return_index=True, return_inverse=True)
    sketch = np.concatenate(sketches)
    del sketches
    # key and item as one number; an item has a key once
    both = np.unique(np.concatenate(keys).astype(U) << U(32) | item[np.concatenate(items)].astype(U))
    key, item = (both >> U(32)).astype(np.int64), (both & U(0xFFFFFFFF)).astype(np.int64)
    new = np.r_[True, key[1:] != key[:-1], True] if len(key) else np.ones(1, bool)
    shared = ~(new[:-1] & new[1:])
    key, item = key[shared], item[shared]
    for at in range(0, len(key), ROWS):
        own = item[at : at + ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(key[at : at + ROWS]), pa.array(sid[own]), binary(sketch[first[own]].ravel(), np.arange(len(own) + 1) * width)], ["key", "sid", "sketch"])


def ones(mask: np.ndarray) -> np.ndarray:
    """The number of true values in each row."""
    if mask.shape[1] % 8 or mask.shape[1] > 248:
        return np.count_nonzero(mask, axis=1)
    return (mask.view(U).sum(1) * U(0x0101010101010101) >> U(56)).astype(np.int64)


def agree(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Whether the sketches of two tables agree, row by row, in ``share`` of the bytes that either has."""
    return ones((a == b) & (a > 0)) >= share * ones((a | b) > 0)


def within(at: np.ndarray, end: np.ndarray, sketch: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a row ``at`` and a later one before its ``end`` with similar sketches, a distance at a time."""
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    apart = 1
    while True:
        more = at + apart < end
        at, end = at[more], end[more]
        if not len(at):
            return np.concatenate(xs), np.concatenate(ys)
        for lo in range(0, len(at), ROWS):
            x = at[lo : lo + ROWS]
            x = x[agree(sketch[x], sketch[x + apart], share)]
            xs.append(x)
            ys.append(x + apart)
        apart += 1


def link(it: Iterator[pa.RecordBatch], width: int, share: float, last: bool, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Edges ``(a, b)`` within the keys of ``(key, sid, sketch)``, sorted by key, that connect all similar items of a key.

    A key's items are held together, up to ``most`` of them (HOT blocks). Those of a key with more go on, as rows ``(a, null, key, sketch)``;
    not if this is the last step.
    """
    most = HOT * BLOCK if most is None else most
    names = ["a", "b", "key", "sketch"]

    def edges(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary())], names)

    def on(key: np.ndarray, sid: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.nulls(len(sid), pa.int64()), pa.array(key), binary(sketch.ravel(), np.arange(len(sid) + 1) * width)], names)

    def compared(key: np.ndarray, sid: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What whole keys give."""
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
        size = np.diff(cut)
        end = np.repeat(cut[1:], size)
        few = np.repeat(size <= FEW, size)
        x, y = within(np.flatnonzero(few), end[few], sketch, share)
        xs, ys = [x], [y]
        for k in np.flatnonzero(size > FEW):
            got = whole(sketch[cut[k] : cut[k + 1]], share)
            if got:
                x, y = np.array(got).T
                xs.append(x + cut[k])
                ys.append(y + cut[k])
        yield from edges(sid[np.concatenate(xs)], sid[np.concatenate(ys)])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of one key, that may go on
    hot = None
    for b in it:
        if not b.num_rows:
            continue
        rows = b.column(0).to_numpy(), b.column(1).to_numpy(), unbinary(b.column(2), np.uint8)[0].reshape(-1, width)
        if hot is not None:
            n = int(np.searchsorted(rows[0], hot, side="right"))
            yield from on(*(v[:n] for v in rows))
            rows = tuple(v[n:] for v in rows)
            if not len(rows[0]):
                continue
            hot = None
        n = int(np.searchsorted(rows[0], rows[0][-1]))
        if n or (held and held[0][0][0] != rows[0][0]):
            held.append(tuple(v[:n] for v in rows))
            yield from compared(*(np.concatenate(v) for v in zip(*held)))
            held = []
        held.append(tuple(v[n:] for v in rows))
        if not last and sum(len(v[0]) for v in held) > most:
            hot = held[0][0][0]
            for v in held:
                yield from on(*v)
            held = []
    if held:
        yield from compared(*(np.concatenate(v) for v in zip(*held)))


def spanning(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`link`, with edges that connect the same items and are fewer than these."""

    def least(ab: list[np.ndarray]) -> np.ndarray:
        node, at = np.unique(np.concatenate(ab), return_inverse=True)
        x, y = np.unique(at.reshape(-1, 2), axis=0).T
        root = summed(len(node), x, y, np.ones(len(node)))[1]
        own = np.flatnonzero(root != np.arange(len(node)))
        return np.c_[node[own], node[root[own]]]

    held: list[np.ndarray] = []
    for b in it:
        if b.column(1).null_count:
            yield b
            continue
        held.append(np.c_[b.column(0).to_numpy(), b.column(1).to_numpy()])
        if sum(len(v) for v in held) > 2 * max(len(held[0]), 1 << 20):
            held = [least(held)]
    if held:
        a, c = least(held).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())], ["a", "b", "key", "sketch"])


def hot_links(items: DataFrame, share: float, tile: int) -> DataFrame:
    """Edges ``(a, b)`` that connect all similar items of each key of ``(comp, sid, sketch)``, whose ``comp`` is the key: every two tiles of it are compared."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        comp, ti, tj, sid = (t.column(c).to_numpy() for c in ("comp", "ti", "tj", "sid"))
        sketch = unbinary(t.column("sketch").combine_chunks(), np.uint8)[0].reshape(len(sid), -1)
        cut = np.flatnonzero(np.r_[True, (np.diff(comp) != 0) | (np.diff(ti) != 0) | (np.diff(tj) != 0), True])
        got = [(a + x, a + y) for a, b in zip(cut, cut[1:]) for x, y in whole(sketch[a:b], share)]
        if got:
            x, y = np.array(got).T
            yield pa.RecordBatch.from_arrays([pa.array(sid[x]), pa.array(sid[y])], ["a", "b"])

    return by_group(tile_pairs(tiled(items, tile), "sid", "sketch"), ["comp", "ti", "tj"], run, "a long, b long", most=BLOCK, order=["side", "sid"])


def meeting(items: DataFrame, keys: Keys, _sketches: DataFrame | None, width: int, share: float, most: int | None = None, tile: int | None = None) -> DataFrame:
    """``(node, comp)`` of the items that share a key and have similar sketches, directly or through others.

    ``items`` begin with ``sid``; equal ones count once. ``keys`` gives a batch's keys and the sketches of ``width`` bytes, 0 for none
    (so a table of sketches isn't read). A key alone may be shared by
    chance or for a common passage; such links would tie everything together. So of
    all pairs of a key those with similar sketches count. This holds for keys of any size: those of up to ``most``
    items are compared by the task of their part, larger ones by pairs of tiles of about ``tile`` items.
    """
    count, cores = items.count(), items.sparkSession.sparkContext.defaultParallelism
    # so many parts that each has HELD items, or all of few; only memory depends on it
    parts = cores if count <= HELD else max(cores, math.ceil(-KEYS / math.log1p(-HELD / count)))
    nodes = items.mapInArrow(lambda it: packed(before_shuffle(it, keys, share), parts), "part int, data binary").repartitionById(parts, F.col("part"))
    found = nodes.mapInArrow(lambda it: spanning(link(unpacked(it, width), width, share, False, most)), "a long, b long, key long, sketch binary")
    tables = [stash(found, "links")]
    edges = tables[0].filter("b is not null").select("a", "b")
    hot = tables[0].filter("b is null").select(F.col("key").alias("comp"), F.col("a").alias("sid"), "sketch")
    if hot.limit(1).count():
        tables.append(stash(hot_links(hot, share, tile or WIDE * BLOCK), "links"))
        edges = edges.union(tables[1])
    found = components(edges)
    discard(*tables)
    return found


def tiled(items: DataFrame, tile: int) -> DataFrame:
    """The items with their ``tile`` within ``comp``, by a hash of ``sid``, and the component's ``last`` tile."""
    count = items.groupBy("comp").agg(F.count("*").alias("n")).select(F.col("comp").alias("of"), (F.ceil(F.col("n") / tile) - 1).cast("int").alias("last"))
    return items.join(count, F.col("comp") == F.col("of")).drop("of").withColumn("tile", F.pmod(F.xxhash64("sid", F.lit(5)), F.col("last") + 1).cast("int"))


def tile_pairs(items: DataFrame, *cols: str) -> DataFrame:
    """The items once for each pair of tiles (ti <= tj) that theirs is part of; ``side`` 1 is tj's."""
    kind = "array<struct<ti:int,tj:int,side:int>>"
    up = F.transform(F.sequence("tile", "last"), lambda j: F.struct(F.col("tile").alias("ti"), j.alias("tj"), F.lit(0).alias("side"))).cast(kind)
    down = F.when(F.col("tile") > 0, F.transform(F.sequence(F.lit(0), F.col("tile") - 1), lambda i: F.struct(i.alias("ti"), F.col("tile").alias("tj"), F.lit(1).alias("side")))).otherwise(F.array()).cast(kind)
    return items.select("comp", "last", *cols, F.explode(F.concat(up, down)).alias("p")).select("comp", "last", "p.ti", "p.tj", "p.side", *cols)


def summed(n: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of n items with hits (x, y): the weights of an item's partners, and the first item of its tree."""
    links = np.bincount(x, weight[y], n) + np.bincount(y, weight[x], n)
    root = np.arange(n)
    while True:  # least labels, with short cuts
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return links.astype(np.int64), root
        root = new


def found_links(items: DataFrame, payload: str, hits: Hits, most: int) -> DataFrame:
    """``(sid, root, links, last)`` of ``(comp, sid, w, tile, last, payload)``: what each pair of tiles says of its items.

    ``hits`` gets a table of tile pairs and each one's rows on the left and on the right, and gives the rows
    that are linked. So the rows out grow with the items, not with their pairs.
    """

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        comp, ti, tj, side, sid, w, last = (t.column(c).to_numpy() for c in ("comp", "ti", "tj", "side", "sid", "w", "last"))
        cut = np.r_[0, np.flatnonzero((np.diff(comp) != 0) | (np.diff(ti) != 0) | (np.diff(tj) != 0)) + 1, len(comp)]
        x_all, y_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cut, cut[1:]):
            own = a + np.flatnonzero(np.r_[True, (sid[a + 1 : b] != sid[a : b - 1]) | (side[a + 1 : b] != side[a : b - 1])])  # repeated rows count once
            left, right = (own, own) if ti[a] == tj[a] else (own[side[own] == 0], own[side[own] == 1])
            if len(left) and len(right):
                x, y = hits(t, left, right)
                x_all.append(x)
                y_all.append(y)
        x, y = np.concatenate(x_all), np.concatenate(y_all)
        if len(x):
            links, root = summed(len(sid), x, y, w)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(sid[at]), pa.array(sid[root[at]]), pa.array(links[at]), pa.array(last[at])], ["sid", "root", "links", "last"])

    return by_group(tile_pairs(items, "sid", "w", payload), ["comp", "ti", "tj"], run, "sid long, root long, links long, last int", most=most, order=["side", "sid"])


def classes(owners: DataFrame, rep: DataFrame, found: DataFrame) -> DataFrame:
    """The rows ``(doc_id, ..., sid)`` of ``owners`` with ``class_id`` and ``links`` in place of ``sid``.

    ``rep(sid, doc_id, w)`` has the least id and the number of documents of every item, and
    ``found`` what :func:`found_links` gave, as a work table. Rows without an item (null) are a class of their own.
    """
    cols = [c for c in owners.columns if c != "sid"]
    many = found.filter("last > 0").select(F.col("sid").alias("a"), F.col("root").alias("b"))
    member = found.filter("last = 0").select("sid", "root").union(components(many).select(F.col("node").alias("sid"), F.col("comp").alias("root")))
    least = member.join(rep.select("sid", "doc_id"), "sid").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    known = member.join(least, "root").select("sid", "class_id").join(found.groupBy("sid").agg(F.sum("links").alias("links")), "sid")
    item = rep.join(known, "sid", "left").select(F.col("sid").alias("of"), F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    full = owners.filter("sid is not null").distinct().join(item.hint("merge"), F.col("sid") == F.col("of")).select(*cols, "class_id", "links")
    bare = owners.filter("sid is null").select(*cols).distinct().select(*cols, F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return full.unionByName(bare)

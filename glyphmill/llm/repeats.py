"""Repeated passages, by a Burrows-Wheeler transform whose intervals are expanded up to a bound.

A passage is a run of at least LENGTH words that occurs at two places or more.
The transform needs its texts in one place, so fragments that could share a
passage are brought together first: every window of LENGTH words is represented
by its least GRAM-gram, and windows with one representative, of all documents, go
together. Equal windows have equal representatives, so none is missed. A representative
with very many fragments is cut into parts, a transform for each; what the parts
hold is then matched by the windows' hashes, counted without bringing them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, binary, by_group, prepare, stash, texts, unbinary
from .textvec import U, grams, mix, signed, words

LENGTH, GRAM = 50, 20
#: Words of fragments that one transform is built over, about.
CHUNK = 1 << 19


def anchors(h: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash, fragment hash): runs of windows with one least gram.

    Of equal grams the first counts. Windows are numbered by their first word in
    the row; the run's fragment are all words of its windows.
    """
    w = length - gram + 1
    g, to = grams(h, off, gram)
    n = np.maximum(np.diff(to) - w + 1, 0)
    if not n.sum():
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U), z.astype(U)
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = to[row] + pos
    best, where = g.copy(), np.arange(len(g))
    span = 1
    while span < w:  # sliding minima by doubling
        step = min(span, w - span)
        less = best[step:] < best[:-step]
        b2, w2 = best.copy(), where.copy()
        b2[:-step][less], w2[:-step][less] = best[step:][less], where[step:][less]
        best, where, span = b2, w2, span + step
    best, where = best[at], where[at]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (where[1:] != where[:-1])])
    count = np.diff(first, append=len(row))
    # the fragment's words, hashed by prefix sums
    base = U(0x9E3779B97F4A7C15)
    pw = np.full(length + w + 1, base)
    pw[0] = 1
    pw = np.multiply.accumulate(pw)
    a = off[row[first]] + pos[first]
    size = count + length - 1
    frag = np.zeros(len(first), U)
    idx = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    frag = np.add.reduceat(mix(h[idx]) * pw[k], np.cumsum(size) - size)
    return row[first], pos[first], count, best[first], mix(frag + size.astype(U))


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``s`` in order of their first ``depth`` symbols at least, by doubling."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sk = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, sk[1:] != sk[:-1]])
        rank = new
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


def bounded_lcp(s: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """The common prefix of every suffix with the one before it in order, at most ``bound``.

    Breadth first over the intervals of the suffixes that share a prefix: extended
    backward by each symbol that precedes them (on the transform), an interval of
    level v gives intervals of level v + 1. One whose end has no value yet sets it
    to v, and is expanded further; others were reached by shorter prefixes. Values come in
    increasing order, so at the bound the rest are known to be larger or equal.
    """
    n = len(s)
    prev = s[order - 1]  # the transform; the first suffix is preceded by the last symbol
    _, prev = np.unique(np.r_[s, prev], return_inverse=True)
    sym, prev = prev[:n], prev[n:]
    count = np.r_[0, np.cumsum(np.bincount(sym))]
    by = np.argsort(prev, kind="stable")
    step = np.empty(n, np.int64)  # where a suffix's extension by its preceding symbol stands
    step[by] = count[prev[by]] + np.arange(n) - np.searchsorted(prev[by], prev[by])
    lcp = np.full(n + 1, -1, np.int64)
    lcp[0] = lcp[n] = 0
    lo, hi = np.array([0]), np.array([n])
    for v in range(bound):
        size = hi - lo
        own = np.repeat(np.arange(len(lo)), size)
        pos = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        to = step[pos]
        o = np.lexsort((to, own))
        to, own, c = to[o], own[o], prev[pos[o]]
        cut = np.r_[True, (own[1:] != own[:-1]) | (c[1:] != c[:-1])] if len(to) else np.zeros(0, bool)
        first = np.flatnonzero(cut)
        a = to[first]
        b = a + np.diff(first, append=len(to))
        fresh = lcp[b] < 0
        lcp[b[fresh]] = v
        # the last interval of a level ends where values are set from the start: it goes on
        go = fresh | ((b == n) & (b - a > 1))
        lo, hi = a[go], b[go]
        if not len(lo):
            break
    lcp[lcp < 0] = bound
    return lcp[:n]


def repeated(s: np.ndarray, bound: int) -> np.ndarray:
    """Whether the ``bound`` symbols from each position on occur at another one."""
    order = suffix_order(s, bound)
    lcp = np.r_[bounded_lcp(s, order, bound), 0]
    out = np.empty(len(s), bool)
    out[order] = (lcp[:-1] >= bound) | (lcp[1:] >= bound)
    return out


def find(t: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """(fragment, first, last, null): runs of windows of the fragments that occur more than once.

    Of a fragment whose representative has several parts, (fragment, window, window, hash) for
    the windows that are alone in this part; and (null, null, null, hash) once for each one found here.
    """
    frag, n, parts = (t.column(c).to_numpy() for c in ("frag", "n", "parts"))
    flat, off = unbinary(pa.chunked_array(t.column("grams").chunks).combine_chunks(), np.uint32)
    size = np.diff(off)
    # a closing symbol of its own ends every fragment
    to = off + np.arange(len(off))
    s = np.empty(to[-1], np.int64)
    inner = np.ones(len(s), bool)
    inner[to[1:] - 1] = False
    s[inner] = flat
    s[~inner] = (1 << 32) + np.arange(len(size))
    rep = repeated(s, length)
    rep[~inner] = False
    many = np.repeat(n > 1, size + 1)  # a fragment that several places have is repeated as a whole
    left = np.repeat(to[1:], size + 1) - 1 - np.arange(len(s))
    window = left >= length
    hit = np.flatnonzero((rep | many) & window)
    f = np.searchsorted(to, hit, side="right") - 1
    at = (hit - to[f]).astype(np.int32)
    cut = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (at[1:] != at[:-1] + 1)]) if len(f) else f
    last = np.r_[cut[1:] - 1, len(f) - 1] if len(f) else f
    names = ["frag", "a", "b", "h"]
    yield pa.RecordBatch.from_arrays([pa.array(frag[f[cut]]), pa.array(at[cut]), pa.array(at[last]), pa.nulls(len(cut), pa.int64())], names)
    open_ = np.flatnonzero(window & np.repeat(parts > 1, size + 1))
    if len(open_):
        f = np.searchsorted(to, open_, side="right") - 1
        h = signed(grams(mix(s.astype(U)), np.array([0, len(s)]), length)[0][open_])
        done = (rep | many)[open_]
        at = (open_ - to[f]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x[~done]) for x in (frag[f], at, at, h)], names)
        known = np.unique(h[done])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(known), pa.int64()), pa.nulls(len(known), pa.int32()), pa.nulls(len(known), pa.int32()), pa.array(known)], names)


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start_word, end_word)`` of every passage that other places have too.

    Words are counted from 0 in the text, ``end_word`` is the last one's. A word is
    in a passage if some ``length`` words in a row with it occur at another place, in
    another document or the same. Passages that overlap or touch are one.

    Steps: (1) the runs of windows with one anchor, and anchors at more than one place;
    (2) of these the distinct fragments only; (3) for those that share an anchor one
    transform, or for every ``chunk`` words of them, and the repeated windows by its bounded common prefixes; where an anchor
    has several transforms, the windows that one holds once are matched with the others' by hash; (4) back
    to the documents. Texts with fewer words than ``length``, null and empty ones have no
    passages; rows with a null id are left out; rows of equal id and text are one place,
    texts that differ under one id are places of their own; an empty table gives none.

    Words stand as 32-bit hashes: windows of different words would be taken for equal with a chance of
    2**-32 each, if all other words agree.
    """
    prepare(docs.sparkSession)
    # a document is its id and text in one number
    d = texts(docs, id_col, text_col).filter("doc_id is not null").withColumn("doc", F.xxhash64("doc_id", "text"))

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            w = words(b.column(0))
            row, start, count, anchor, frag = anchors(w.hashes, w.off, length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), pa.array(signed(frag)), b.column(1).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], ["anchor", "frag", "doc", "start", "windows"])

    marks = stash(d.select("text", "doc").mapInArrow(mark, "anchor long, frag long, doc long, start int, windows int"), "anchors")
    # repeated rows are one place
    place = F.xxhash64("doc", "start")
    shared = marks.select("anchor", place.alias("p")).groupBy("anchor").agg(F.min("p").alias("p"), F.max("p").alias("q")).filter("p <> q").select("anchor")
    live = stash(marks.join(shared, "anchor", "left_semi").distinct(), "fragments")
    frags = stash(live.groupBy("anchor", "frag").agg(F.min(F.struct("doc", "start", "windows")).alias("one"), F.count("*").alias("n")), "distinct-fragments")
    # a hot anchor's fragments go to several parts
    most = max(1, chunk // (length + 12))
    hot = frags.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > most).select(F.col("anchor").alias("of_anchor"), F.ceil(F.col("c") / most).cast("int").alias("p"))
    split = frags.join(hot, F.col("anchor") == F.col("of_anchor"), "left").withColumn("parts", F.coalesce("p", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("frag"), F.col("parts")).cast("int"))
    # the fragments' words, each from one of its places
    wanted = split.select(F.col("one.doc").alias("of"), F.struct("anchor", "part", "parts", "frag", F.least("n", F.lit(2)).cast("int").alias("n"), F.col("one.start").alias("start"), F.col("one.windows").alias("windows")).alias("w")).groupBy("of").agg(F.collect_list("w").alias("want"))
    near = d.select("text", "doc").join(wanted, F.col("doc") == F.col("of")).select("text", "want")

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            w = words(b.column(0))
            want = b.column(1)
            flat = want.flatten()
            row = np.repeat(np.arange(b.num_rows), want.value_lengths().to_numpy())
            col = {k: flat.field(k) for k in ("anchor", "part", "parts", "frag", "n", "start", "windows")}
            size = col["windows"].to_numpy().astype(np.int64) + length - 1
            a = w.off[row] + col["start"].to_numpy()
            to = np.concatenate([[0], np.cumsum(size)])
            idx = np.repeat(a - to[:-1], size) + np.arange(to[-1])
            yield pa.RecordBatch.from_arrays([col["anchor"], col["part"], col["parts"], col["frag"], col["n"], binary((w.hashes[idx] >> U(32)).astype(np.uint32), to)], ["anchor", "part", "parts", "frag", "n", "grams"])

    content = near.mapInArrow(fetch, "anchor long, part int, parts int, frag long, n int, grams binary")
    runs_found = stash(by_group(content, ["anchor", "part"], lambda t: find(t, length), "frag long, a int, b int, h long", most=most, order=["frag"]), "runs")
    alone = runs_found.filter("h is not null")
    twice = alone.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1").select(F.col("h").alias("of_h"))
    across = alone.filter("frag is not null").join(twice, F.col("h") == F.col("of_h")).select("frag", "a", "b")
    found = runs_found.filter("h is null").select("frag", "a", "b").union(across)
    hits = live.select("frag", "doc", "start").join(found, "frag").select("doc", (F.col("start") + F.col("a")).alias("first"), (F.col("start") + F.col("b")).alias("last"))
    w = Window.partitionBy("doc").orderBy("first", "last")
    # a run of windows joins those before it if it starts inside or right after them
    ahead = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("new", F.coalesce((F.col("first") > ahead + length).cast("int"), F.lit(1)))
    runs = runs.withColumn("passage", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc", "passage").agg(F.min("first").alias("start_word"), (F.max("last") + length - 1).cast("int").alias("end_word"))
    ids = d.select(F.col("doc").alias("of"), "doc_id").distinct()
    return spans.join(ids, F.col("doc") == F.col("of")).select("doc_id", "start_word", "end_word")


SQL = f"""
WITH t AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(0, len(w) - {LENGTH - 1}), lambda i: {{'i': i, 'h': md5(array_to_string(w[i + 1 : i + {LENGTH}], ' '))}})) AS x FROM t WHERE len(w) >= {LENGTH}),
f AS (SELECT doc_id, x.i AS first, count(*) OVER (PARTITION BY x.h) AS n FROM g),
r AS (SELECT doc_id, first, CASE WHEN first > lag(first) OVER (PARTITION BY doc_id ORDER BY first) + {LENGTH} OR lag(first) OVER (PARTITION BY doc_id ORDER BY first) IS NULL THEN 1 ELSE 0 END AS new FROM f WHERE n > 1),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY first ROWS UNBOUNDED PRECEDING) AS passage FROM r)
SELECT doc_id, CAST(min(first) AS INTEGER) AS start_word, CAST(max(first) + {LENGTH - 1} AS INTEGER) AS end_word FROM p GROUP BY doc_id, passage
"""

"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, buffer, prepare, stash, texts, unused
from .textvec import U, grams, mix, signed, span_hashes

#: Lines in a gram, and grams in a window: runs of GRAM + WINDOW - 1 lines are found for certain.
GRAM, WINDOW = 1, 2
#: A line of so many bytes is a run by itself.
LONG = 64
SPACE = np.isin(np.arange(256), [9, 11, 12, 13, 32])


def lines(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lines that aren't blank, without white space at their ends, the rows' offsets, and the lines' bytes."""
    data, off = buffer(arr)
    if not len(data):
        return np.zeros(0, U), np.zeros(len(off), np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, off[:-1])
    starts = starts[starts < len(data)]
    ends = np.minimum(np.r_[breaks, len(data)][np.searchsorted(breaks, starts)], off[np.searchsorted(off, starts, side="right")])
    solid = np.flatnonzero(~SPACE[data] & (data != 10))
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    keep = b > a
    first, last = solid[a[keep]], solid[b[keep] - 1] + 1
    return span_hashes(data, first, last), np.searchsorted(first, off), last - first


def minima(g: np.ndarray, to: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first gram, chosen gram) of every window of ``w`` grams: its least one, of equal ones the last."""
    n = np.maximum(np.diff(to) - w + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = to[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    best, where = (g[at], at.copy()) if len(at) else (np.zeros(0, U), at)
    for x in range(1, w):
        less = g[at + x] <= best
        best, where = np.where(less, g[at + x], best), np.where(less, at + x, where)
    return row, at, where


def winnow(h: np.ndarray, off: np.ndarray, size: np.ndarray, k: int, w: int, long: int) -> tuple[np.ndarray, ...]:
    """The fingerprints of rows of lines: (row, line, fingerprint, first window, windows, hashes around).

    Of every window of ``w`` grams of ``k`` lines the least gram is selected. A selected gram stands here
    once, with the windows that selected it, and the hashes of its windows' lines, so that matches
    can be extended both ways without a look at the text. A line of ``long`` bytes is selected by
    itself: its row has 0 windows.
    """
    g, to = grams(h, off, k)
    row, at, where = minima(g, to, w)
    # windows follow each other; those with one choice are neighbours
    new = np.r_[True, where[1:] != where[:-1]] if len(where) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(first, append=len(where))
    r = row[first]
    line = where[first] - to[r]
    start = at[first] - to[r]
    span = count + (k + w - 2)
    idx = np.repeat(off[r] + start - (np.cumsum(span) - span), span) + np.arange(span.sum())
    alone = np.flatnonzero(size >= long)
    ar = np.searchsorted(off, alone, side="right") - 1
    pick = np.r_[r, ar]
    fp = np.r_[g[where[first]], mix(h[alone] ^ U(0x5851F42D4C957F2D))]
    around = np.r_[h[idx], h[:0]]
    to_around = np.r_[0, np.cumsum(np.r_[span, np.zeros(len(alone), np.int64)])]
    return pick, np.r_[line, alone - off[ar]], fp, np.r_[start, alone - off[ar]], np.r_[count, np.zeros(len(alone), np.int64)], around, to_around


def extended(fp: np.ndarray, count: np.ndarray, around: np.ndarray, to: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint's row, offset, match hash): a fingerprint extended both ways to each of its windows of ``t`` lines.

    Equal hashes mean equal lines before and after equal fingerprints. A long line is its own match, at offset 0.
    """
    row = np.repeat(np.arange(len(fp)), np.maximum(count, 1))
    n = np.maximum(count, 1)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = fp[row].copy()
    many = count[row] > 0
    at = to[:-1][row[many]] + k[many]
    v = np.zeros(len(at), U)
    for x in range(t):
        v = mix(v * U(0x9FB21C651E98DF25) + around[at + x]) if len(at) else v
    out[many] = mix(out[many] * U(31) + v)
    return row, k, out


def repeats(docs: DataFrame, gram: int, window: int, long: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, tkey, start, lines)``: runs whose like occurs earlier, by id, text hash and line."""
    prepare(docs.sparkSession)
    t = gram + window - 1

    def select(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            h, off, size = lines(b.column(1))
            row, _, fp, start, count, around, to = winnow(h, off, size, gram, window, long)
            at = pa.array(row)
            lists = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(signed(around)))
            yield pa.RecordBatch.from_arrays([pa.array(signed(fp)), b.column(0).take(at), b.column(2).take(at), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), lists], ["fp", "doc_id", "tkey", "start", "windows", "around"])

    def extend(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp, start, count = (b.column(k).to_numpy() for k in (0, 3, 4))
            lists = b.column(5)
            to = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            row, k, match = extended(fp.view(U), count, lists.flatten().to_numpy(zero_copy_only=False).view(U), to, t)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(signed(match)), b.column(1).take(at), b.column(2).take(at), pa.array((start[row] + k).astype(np.int32)), pa.array(np.where(count[row] > 0, t, 1).astype(np.int32))], ["match", "doc_id", "tkey", "start", "lines"])

    d = texts(docs, id_col, text_col).filter("doc_id is not null").withColumn("tkey", F.xxhash64("text"))
    found = stash(d.mapInArrow(select, "fp long, doc_id long, tkey long, start int, windows int, around array<long>"), "line-fingerprints")
    # fingerprints at one place only go first; partial counts keep a common line from being a hot key
    place = F.xxhash64("doc_id", "tkey", "start")
    shared = found.select("fp", place.alias("p")).groupBy("fp").agg(F.min("p").alias("p"), F.max("p").alias("q")).filter("p <> q").select("fp")
    matches = stash(found.join(shared.hint("merge"), "fp").select("fp", "doc_id", "tkey", "start", "windows", "around").mapInArrow(extend, "match long, doc_id long, tkey long, start int, lines int"), "line-matches")
    first = matches.groupBy("match").agg(F.min(F.struct("doc_id", "tkey", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("match", "first")
    return matches.join(first.hint("merge"), "match").filter(F.struct("doc_id", "tkey", "start") > F.col("first")).select("doc_id", "tkey", "start", "lines")


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long: int = LONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start_line, end_line)`` of the runs of lines to delete.

    Lines are counted from 0 without blank ones; ``end_line`` is the last line of
    the run. A run of ``gram + window - 1`` lines, or one line of ``long`` bytes, is repeated if the
    same lines (but for white space at their ends) stand in a document with a smaller id, or
    earlier in the same document; so the first occurrence stays, and shorter runs do. Repeated runs that
    overlap or touch are one.

    The least gram of each window is its fingerprint, and only selected grams are kept (2 of 3 lines for windows of 2).
    Fingerprints that stand at several places are joined and extended both ways over their windows' lines, so
    every repeated run is found whole.

    Null or empty texts have no lines; rows with a null id are left out; rows with
    equal id and text are one document; texts that differ under one id count apart, in
    the order of their hashes; an empty table gives none.
    """
    covered = repeats(docs, gram, window, long, id_col, text_col).select("doc_id", "tkey", F.explode(F.sequence("start", F.col("start") + F.col("lines") - 1)).alias("line")).distinct()
    w = Window.partitionBy("doc_id", "tkey").orderBy("line")
    return covered.withColumn("island", F.col("line") - F.row_number().over(w)).groupBy("doc_id", "tkey", "island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).select("doc_id", "start_line", "end_line")


def cut(text: str, runs: list[tuple[int, int]]) -> str | None:
    """The text without the runs (first line, lines); None if no line is left."""
    drop = {s + k for s, n in runs for k in range(n)}
    out, n, left = [], 0, False
    for line in text.split("\n"):
        if line.strip(" \t\r\v\f"):
            n += 1
            if n - 1 in drop:
                continue
            left = True
        out.append(line)
    return "\n".join(out) if left else None


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long: int = LONG, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents, with all their columns, without later repeats of :func:`repeated_runs`.

    A document of which no line is left goes; others stay, also those with a
    null id or without text. Where there is a column ``length_col``, it gets the
    length of a text that changed. Repeated rows are cut alike; an empty table stays empty.
    """
    prepare(docs.sparkSession)
    qd, qt, qs = unused(docs, "doc", "tkey", "runs")
    marks = repeats(docs, gram, window, long, id_col, text_col).groupBy(F.col("doc_id").alias(qd), F.col("tkey").alias(qt)).agg(F.collect_set(F.struct("start", "lines")).alias(qs))
    key = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None
    joined = docs.join(marks.hint("merge"), (docs[id_col].cast("long") == marks[qd]) & (key == marks[qt]), "left").drop(qd, qt)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, text_col):
            cols = list(b.columns)
            runs = cols.pop()
            hit = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                text = cols[at].to_pylist()
                keep = np.ones(b.num_rows, bool)
                lens = cols[size].to_pylist() if size is not None else None
                for i in hit:
                    text[i] = cut(text[i] or "", [(r["start"], r["lines"]) for r in runs[int(i)].as_py()])
                    keep[i] = text[i] is not None
                    if lens is not None and keep[i]:
                        lens[i] = len(text[i])
                cols[at] = pa.array(text, cols[at].type)
                if lens is not None:
                    cols[size] = pa.array(lens, cols[size].type)
                b = pa.RecordBatch.from_arrays(cols, b.schema.names[:-1]).filter(pa.array(keep))
            else:
                b = pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])
            yield b

    return joined.mapInArrow(run, docs.schema)


SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
nb AS (SELECT doc_id, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM l WHERE trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
w AS (SELECT doc_id, pos, 2 AS n, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS win FROM nb UNION ALL SELECT doc_id, pos, 1, line FROM nb WHERE strlen(line) >= {LONG}),
r AS (SELECT doc_id, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM w WHERE win IS NOT NULL) WHERE nth > 1),
c AS (SELECT DISTINCT doc_id, pos + k AS line FROM r, (VALUES (0), (1)) AS t(k) WHERE k < n),
g AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM c)
SELECT doc_id, CAST(min(line) AS INTEGER) AS start_line, CAST(max(line) AS INTEGER) AS end_line FROM g GROUP BY doc_id, island
"""

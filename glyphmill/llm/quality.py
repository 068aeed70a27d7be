"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, buffer, prepare, texts
from .textvec import distinct, grams, row_reduce, words

#: The most labelled rows that a model is fitted on.
SAMPLE = 20_000
KEEP = 0.5
FEATURES = ("log_words", "word_bytes", "upper", "symbols", "exclaim", "stops", "digits", "distinct_words", "top_word", "log_line", "echo", "repeated_3grams", "commas", "non_ascii", "short_words", "bars")

_set = lambda s: np.isin(np.arange(256), list(s.encode())).astype(np.uint8)
UPPER, LOWER, DIGITS = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("abcdefghijklmnopqrstuvwxyz"), _set("0123456789")
SYMBOLS, EXCLAIM, STOPS, COMMAS, BARS, NEWLINE = _set("#$%&*^~{}<>@\\=+_"), _set("!?"), _set(".:;"), _set(","), _set("|"), _set("\n")
HIGH = (np.arange(256) >= 128).astype(np.uint8)


def features(arr: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, off = buffer(arr)
    w = words(arr)
    size = np.maximum(np.diff(off), 1).astype(float)
    n = np.diff(w.off)
    one = np.maximum(n, 1).astype(float)

    def count(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=c[1:])
        return np.diff(c[at])

    up, low = count(UPPER[data], off), count(LOWER[data], off)
    span = w.end - w.start
    d, to = distinct(w.hashes, w.off)
    g, go = grams(w.hashes, w.off, 3)
    _, gd = distinct(g, go)
    echo = np.zeros(len(w.hashes), np.uint8)
    if len(echo) > 1:
        echo[1:] = w.hashes[1:] == w.hashes[:-1]
        echo[w.off[:-1][w.off[:-1] < len(echo)]] = 0
    # the count of each row's most frequent word: run lengths of the sorted hashes
    order = np.lexsort((w.hashes, w.row))
    h, r = w.hashes[order], w.row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    top = row_reduce(np.maximum, np.diff(first, append=len(h)), to, 0)
    ng = np.maximum(np.diff(go), 1)
    cols = [
        np.log1p(n), np.add.reduceat(np.r_[span, 0], np.minimum(w.off[:-1], len(span))) * (n > 0) / one, up / np.maximum(up + low, 1), count(SYMBOLS[data], off) / size, count(EXCLAIM[data], off) / one, count(STOPS[data], off) / one,
        count(DIGITS[data], off) / size, np.diff(to) / one ** 0.8, top / one, np.log1p(size / (1 + count(NEWLINE[data], off))), count(echo, w.off) / one, 1 - np.diff(gd) / ng, count(COMMAS[data], off) / one, count(HIGH[data], off) / size,
        count(span <= 2, w.off) / one, count(BARS[data], off) / one,
    ]
    return np.stack(cols, 1).astype(float)


class Model(NamedTuple):
    """Lookup tables: for each feature its bin edges and scores, and for pairs a grid."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: one addition of a looked-up number for each feature and pair."""
        z = np.full(len(x), self.bias)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        if self.pairs:
            c = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.coarse)]
            for a, b, t in self.pairs:
                z += t[c[a], c[b]]
        return 1 / (1 + np.exp(-z))


def quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(x) else np.zeros(0)


def shallow(g: np.ndarray, h: np.ndarray, leaves: int, lam: float) -> np.ndarray:
    """A tree on one binned feature, as the value of every bin: greedily split leaves."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + lam)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best, where = 1e-12, 0
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = value(a, k) + value(k, b) - value(a, b)
                if gain.max() > best:
                    best, where = gain.max(), int(k[gain.argmax()])
        if not where:
            break
        cuts = sorted([*cuts, where])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + lam)
    return out


def crossed(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """The best tree of depth two on a pair: one cut of either feature, four leaves."""
    G, H = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    quad = lambda S: (S[1:-1, 1:-1], S[1:-1, -1:] - S[1:-1, 1:-1], S[-1:, 1:-1] - S[1:-1, 1:-1], S[-1, -1] - S[1:-1, -1:] - S[-1:, 1:-1] + S[1:-1, 1:-1])
    qg, qh = quad(G), quad(H)
    if not qg[0].size:
        return np.zeros_like(g), 0.0
    gain = sum(a * a / (b + lam) for a, b in zip(qg, qh))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    v = [np.broadcast_to(a, gain.shape)[i, j] / (np.broadcast_to(b, gain.shape)[i, j] + lam) for a, b in zip(qg, qh)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, grid: int = 12, cycles: int = 120, pair_cycles: int = 40, pairs: int = 8, rate: float = 0.15, leaves: int = 3, lam: float = 2.0) -> Model:
    """Boost shallow trees feature by feature in cycles, then on the strongest pairs.

    Labels of one class only, or none, give a constant model.
    """
    good = float(y.sum())
    bias = float(np.log((good + 1) / (len(y) - good + 1)))
    edges, coarse = ([quantiles(x[:, f], k) for f in range(x.shape[1])] for k in (bins, grid))
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not 0 < good < len(y):
        return Model(bias if len(y) else 20.0, edges, tables, coarse, [])
    z = np.full(len(y), bias)
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    for _ in range(cycles):
        for f, (b, t) in enumerate(zip(at, tables)):
            if len(t) > 1:
                p = 1 / (1 + np.exp(-z))
                step = rate * shallow(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), leaves, lam)
                t += step
                z += step[b]
    c = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    n = [len(e) + 1 for e in coarse]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        k = c[a] * n[b] + c[b]
        return np.bincount(k, y - p, n[a] * n[b]).reshape(n[a], n[b]), np.bincount(k, p * (1 - p), n[a] * n[b]).reshape(n[a], n[b])

    ranked = sorted(((-crossed(*grids(a, b), lam)[1], a, b) for a in range(len(n)) for b in range(a) if n[a] > 1 and n[b] > 1))[:pairs]
    found = [(a, b, np.zeros((n[a], n[b]))) for _, a, b in ranked]
    for _ in range(pair_cycles):
        for a, b, t in found:
            step = rate * crossed(*grids(a, b), lam)[0]
            t += step
            z += step[c[a], c[b]]
    return Model(bias, edges, tables, coarse, found)


def labelled(labels: DataFrame, label_col: str, sample: int, id_col: str = "doc_id") -> DataFrame:
    """``(label_id, y)``: at most ``sample`` ids, by a hash of the id. An id whose labels differ has none."""
    own = labels.select(labels[id_col].cast("long").alias("label_id"), labels[label_col].cast("int").alias("y")).filter("label_id is not null and y in (0, 1)")
    own = own.groupBy("label_id").agg(F.min("y").alias("y"), F.max("y").alias("__most")).filter("y = __most").drop("__most")
    return own.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id") -> Model:
    """Fit on at most ``sample`` labelled documents; their features only come to the driver."""
    prepare(docs.sparkSession)
    few = docs.sparkSession.createDataFrame([(r.label_id, r.y) for r in labelled(labels, label_col, sample, label_id).collect()], "label_id long, y int")
    d = texts(docs, id_col, text_col)
    # at most ``sample`` rows of 12 bytes
    own = d.join(F.broadcast(few), d["doc_id"] == few["label_id"]).select("text", "y", "doc_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["doc_id", "y", *FEATURES])

    got = own.mapInArrow(run, "doc_id long, y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas().drop_duplicates()
    got = got.sort_values(["doc_id", *FEATURES], kind="stable")
    return fit(got[list(FEATURES)].to_numpy(float), got["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row: the probability of good quality.

    Null and empty texts are scored as texts without words; a null id stays null;
    repeated rows get equal scores; an empty table gives none.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(shared.value.score(features(b.column(1))), 6))], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: Model, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score at least ``keep``; no shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, text_col):
            text = b.column(at)
            yield b.filter(pa.array(np.round(shared.value.score(features(text)), 6) >= keep))

    return docs.mapInArrow(run, docs.schema)

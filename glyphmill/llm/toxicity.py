"""Toxicity: a bag of subword embeddings, averaged into a linear softmax.

A word is the bag of its character n-grams of 3 to 5 bytes (with ``<`` and ``>``
at its ends) and itself, each hashed to an embedding. A passage is the average
of its words' vectors; a linear softmax gives its class. Embeddings and softmax
are trained jointly. Misspelt words share most n-grams with the right ones.

A few toxic words vanish in the average of a long document, so a document is read
as overlapping windows of words, and its score is that of its worst window. In
training, the windows of a toxic document take turns: after some passes over
all of them, only those that the model finds worst count as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, buffer, prepare, texts
from .quality import labelled
from .textvec import U, Words, mix, row_reduce, words

#: The most labelled documents that a model is fitted on.
SAMPLE = 6_000
WINDOW, STRIDE = 8, 4
BUCKETS, DIM, SIZES = 1 << 17, 8, (3, 4, 5)
#: Training documents that a subword must be in; the vectors of others stay 0 and say nothing.
LEAST = 4


def collapsed(w: Words) -> Words:
    """A run of one word counts once."""
    new = np.ones(len(w.hashes), bool)
    new[1:] = w.hashes[1:] != w.hashes[:-1]
    new[w.off[:-1][w.off[:-1] < len(new)]] = True
    return Words(w.hashes[new], np.concatenate([[0], np.cumsum(new)])[w.off], w.start[new], w.end[new])


def subwords(arr: pa.Array):
    """(bucket, word) of all n-grams in the texts, and the texts' words."""
    low = pc.utf8_lower(arr)
    data, _ = buffer(low)
    w = collapsed(words(low, lower=False))
    n = w.end - w.start
    # every word between < and >, in one buffer
    size = n + 2
    to = np.concatenate([[0], np.cumsum(size)])
    flat = np.empty(to[-1], np.uint8)
    flat[to[:-1]], flat[to[1:] - 1] = 60, 62
    at = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n)
    flat[np.repeat(to[:-1] + 1, n) + at] = data[np.repeat(w.start, n) + at]
    v = flat.astype(U) + U(1)
    word = np.repeat(np.arange(len(n), dtype=np.int32), size)
    grams_, owners = [(w.hashes % U(BUCKETS)).astype(np.int32)], [np.arange(len(n), dtype=np.int32)]
    left = np.repeat(to[1:], size) - np.arange(to[-1])  # bytes to the word's end
    h = v.copy()
    for k in range(1, max(SIZES)):
        h = h[:-1] * U(0x100000001B3) + v[k:]
        if k + 1 in SIZES:
            ok = left[: len(h)] > k
            grams_.append((mix(h[ok] + U(k)) % U(BUCKETS)).astype(np.int32))
            owners.append(word[: len(h)][ok])
    return np.concatenate(grams_), np.concatenate(owners), w


def windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end) of the overlapping windows; a short row is one window."""
    n = np.diff(off)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = off[row] + k * STRIDE
    return row, start, np.minimum(start + WINDOW, off[row + 1])


class Model(NamedTuple):
    """As scoring needs it: what each subword adds to the log-odds, and the bias."""

    weight: np.ndarray
    bias: float
    shift: float

    def score(self, arr: pa.Array) -> np.ndarray:
        """The probability of the worst window of each text; 0 without words."""
        if not len(self.weight):
            return np.zeros(len(arr))
        g, owner, w = subwords(arr)
        n = len(w.hashes)
        word = np.bincount(owner, self.weight[g], n) / np.maximum(np.bincount(owner, minlength=n), 1)
        total = np.concatenate([[0.0], np.cumsum(word)])
        row, a, b = windows(w.off)
        z = (total[b] - total[a]) / np.maximum(b - a, 1) + self.bias - self.shift
        to = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(arr)))])
        return row_reduce(np.maximum, 1 / (1 + np.exp(-np.clip(z, -50, 50))), to, 0.0)


def fit(rows: list[str], y: np.ndarray, passes: int = 3, refine: int = 4, rate: float = 0.05, batch: int = 512, steps: int = 120, seed: int = 7) -> Model:
    """Train on texts and labels. One class only, or no rows: a model that scores 0."""
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(0, np.float32), 0.0, 0.0)
    rng = np.random.default_rng(seed)
    low = pc.utf8_lower(pa.array(rows, pa.string()))
    w = collapsed(words(low, lower=False))
    _, first, same = np.unique(w.hashes, return_index=True, return_inverse=True)
    data, _ = buffer(low)
    own = pa.array([data[a:b].tobytes().decode() for a, b in zip(w.start[first], w.end[first])], pa.string())
    bag, owner, _ = subwords(own)  # of every distinct word
    bag = bag[np.argsort(owner, kind="stable")]
    size = np.bincount(owner, minlength=len(first))
    at = np.concatenate([[0], np.cumsum(size)])
    row, a, b = windows(w.off)
    label = y[row]
    E = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    # documents that have a subword, in blocks of documents
    held_by = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(rows), 32):
        doc = np.repeat(np.arange(lo, min(lo + 32, len(rows))), np.diff(w.off[lo : lo + 33]))
        doc, word = np.divmod(np.unique((doc - lo) * len(first) + same[w.off[lo] : w.off[min(lo + 32, len(rows))]]), max(len(first), 1))
        n = size[word]
        sub = bag[np.repeat(at[word] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(n) else bag[:0]
        seen = np.zeros((32, BUCKETS), bool)
        seen[np.repeat(doc, n), sub] = True
        held_by += seen.sum(0)
    known = held_by >= LEAST
    E[~known] = 0
    W, bias = (rng.standard_normal((DIM, 2)) * 0.1).astype(np.float32), np.zeros(2, np.float32)
    mE, mW, mb = (np.zeros_like(x) for x in (E, W, bias))

    def vectors(k: np.ndarray) -> tuple[np.ndarray, ...]:
        """For windows k: their distinct words, weights and averages."""
        m = b[k] - a[k]
        win = np.repeat(np.arange(len(k)), m)
        tok = same[np.repeat(a[k] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())]
        ids, inv = np.unique(tok, return_inverse=True)
        s = size[ids]
        sub = bag[np.repeat(at[ids] - np.concatenate([[0], np.cumsum(s)[:-1]]), s) + np.arange(s.sum())]
        starts = np.concatenate([[0], np.cumsum(s)[:-1]])
        wv = np.add.reduceat(E[sub], starts, axis=0) / s[:, None]
        avg = np.add.reduceat(wv[inv], np.concatenate([[0], np.cumsum(m)[:-1]]), axis=0) / m[:, None]
        return win, inv, m, s, sub, avg

    def step(k: np.ndarray, t: np.ndarray) -> None:
        win, inv, m, s, sub, avg = vectors(k)
        z = avg @ W + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(k)), t] -= 1
        p /= len(k)
        d = (p @ W.T) / m[:, None]
        dw = np.stack([np.bincount(inv, d[win, c], len(s)) for c in range(DIM)], 1) / s[:, None]
        ids, where = np.unique(sub, return_inverse=True)
        dsub = np.repeat(dw, s, axis=0) * known[sub][:, None]
        dE = np.stack([np.bincount(where, dsub[:, c], len(ids)) for c in range(DIM)], 1).astype(np.float32)
        mE[ids] += dE**2  # Adagrad
        E[ids] -= rate * dE / (np.sqrt(mE[ids]) + 1e-8)
        for x, mx, dx in ((W, mW, avg.T @ p), (bias, mb, p.sum(0))):
            mx += dx**2
            x -= rate * dx / (np.sqrt(mx) + 1e-8)

    def odds() -> np.ndarray:
        score = (E @ (W[:, 1] - W[:, 0])).astype(np.float64)
        wordy = np.add.reduceat(score[bag], at[:-1]) / size
        c = np.concatenate([[0.0], np.cumsum(wordy[same])])
        return (c[b] - c[a]) / np.maximum(b - a, 1) + float(bias[1] - bias[0])

    held = row % 5 == 4  # every fifth document sets the cut
    bad, good = np.flatnonzero((label == 1) & ~held), np.flatnonzero((label == 0) & ~held)
    if not len(bad) or not len(good):
        return Model(np.zeros(0, np.float32), 0.0, 0.0)
    for k in range(passes + refine):
        if k < passes:
            pos = bad
        else:  # the worst window of each toxic document, and all that the model calls toxic
            z = odds()
            by = np.lexsort((-z[bad], row[bad]))
            top = bad[by][np.r_[True, np.diff(row[bad][by]) != 0]]
            pos = np.union1d(top, bad[z[bad] > 0])
        # as many clean windows as toxic ones; later half of them those that look worst
        neg = rng.permutation(good)[: max(len(pos), batch)]
        if k >= passes:
            neg = np.union1d(neg, good[np.argsort(-z[good], kind="stable")[: len(pos)]])
        done = 0
        while done < steps:  # a small sample is passed over again
            k_ = rng.permutation(np.r_[pos, neg])
            for i in range(0, len(k_), batch):
                part = k_[i : i + batch]
                step(part, label[part].astype(int))
                done += 1
    weight = (E @ (W[:, 1] - W[:, 0])).astype(np.float32)
    # the cut between the documents' worst windows that splits the held-out ones best
    if not label[held].any():
        held[:] = True
    z = odds()[held]
    has, start = np.unique(row[held], return_index=True)
    worst = np.maximum.reduceat(z, start)
    t = y[has]
    order = np.argsort(-worst, kind="stable")
    tp = np.cumsum(t[order])
    f = 2 * tp / (np.arange(1, len(order) + 1) + t.sum())
    i = int(f.argmax())
    # in the gap nearer to the clean side, as misspelt words score less than those of the sample
    cut = float(worst[order[i]] + 3 * worst[order[min(i + 1, len(order) - 1)]]) / 4
    return Model(weight, float(bias[1] - bias[0]), cut)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id", most_bytes: int = 64 << 20) -> Model:
    """Fit on at most ``sample`` labelled documents and ``most_bytes`` of whole texts.

    Documents are taken in the order of a hash of their id; one whose text doesn't fit into what is left of
    the bytes is passed over. Their sizes come to the driver first, and then only the texts that are taken.
    If there are labels of both kinds, but not one text of each fits, that is an error. Null and empty texts,
    null ids and labels, and ids with labels of both kinds are left out; repeated rows count once; texts that differ under one id are documents
    of their own. Without labels of both kinds the model scores 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    few = spark.createDataFrame([(r.label_id, r.y) for r in labelled(labels, label_col, sample, label_id).collect()], "label_id long, y int")
    d = texts(docs, id_col, text_col).filter("text <> ''")
    # at most ``sample`` rows of 12 bytes
    own = d.join(F.broadcast(few), d["doc_id"] == few["label_id"]).select("doc_id", "y", F.xxhash64("text").alias("tkey"), "text")
    place = F.xxhash64("doc_id", F.lit(11))
    # one id may have any number of texts, so the sizes are bounded once more
    sizes = own.select("doc_id", "y", "tkey", F.octet_length("text").alias("size"), place.alias("o")).distinct().orderBy("o", "doc_id", "tkey").limit(sample).collect()
    taken, left = [], most_bytes
    for r in sizes:
        if r["size"] <= left:
            taken.append((r.doc_id, r.tkey))
            left -= r["size"]
    kinds = {(r.doc_id, r.tkey): r.y for r in sizes}
    if len(set(kinds.values())) == 2 and len({kinds[t] for t in taken}) < 2:
        raise ValueError(f"texts of both labels don't fit into {most_bytes} bytes")
    some = spark.createDataFrame(taken, "taken_id long, taken_key long")
    got = own.join(F.broadcast(some), (own["doc_id"] == some["taken_id"]) & (own["tkey"] == some["taken_key"])).select("doc_id", "tkey", "y", "text").distinct().collect()
    got.sort(key=lambda r: (r.doc_id, r.tkey))
    return fit([r.text for r in got], np.array([r.y for r in got], np.int64))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row; from 0.5 a document counts as toxic.

    Null, empty and wordless texts score 0; a null id stays null; repeated rows get
    equal scores; an empty table gives none. Texts are read whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, most=1 << 19):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(shared.value.score(b.column(1)), 6))], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")

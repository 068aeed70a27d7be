import math
import os
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from rows import awkward, empty

from glyphmill.llm.quality import FEATURES, KEEP, crossed, features, fit, keep_quality, labelled, score_quality, shallow, train


def test_features_of_awkward_texts():
    x = features(pa.array(["", None, "?!", "One two, three. One!", "a" * 100_000, "\n\n"], pa.string()))
    assert x.shape == (6, len(FEATURES)) and np.isfinite(x).all()
    at = FEATURES.index
    assert x[3, at("log_words")] == np.log1p(4) and x[3, at("commas")] == 0.25 and x[3, at("top_word")] == 0.5


def test_features_do_not_depend_on_the_batch():
    rows = ["Some text, here.", "", "OTHER text text text", "x\ny | z", "été 12 34"]
    whole = features(pa.array(rows))
    assert np.allclose(whole, np.concatenate([features(pa.array([r])) for r in rows]))


def test_trees():
    g, h = np.array([-1.0, -1, 3, 3, -1]), np.ones(5)
    t = shallow(g, h, 3, 0.0)
    assert t.tolist() == [-1, -1, 3, 3, -1]
    grid, gain = crossed(np.array([[4.0, -4], [-4, 4]]), np.ones((2, 2)), 0.0)
    assert grid.tolist() == [[4, -4], [-4, 4]] and gain == 64


def test_interactions_are_learned():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean() > 0.9
    assert (0, 1) in {tuple(sorted(p[:2])) for p in m.pairs}


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(1)
    x = r.random((500, 2))
    m = fit(x, (x.sum(1) > 1).astype(float))
    z = np.log(m.score(x) / (1 - m.score(x)))
    for k in range(0, 500, 50):
        one = m.bias + sum(t[np.searchsorted(e, v, side="right")] for e, t, v in zip(m.edges, m.tables, x[k]))
        one += sum(t[np.searchsorted(m.coarse[a], x[k, a], side="right"), np.searchsorted(m.coarse[b], x[k, b], side="right")] for a, b, t in m.pairs)
        assert abs(one - z[k]) < 1e-6


def test_degenerate_labels():
    x = np.random.default_rng(2).random((20, 2))
    assert (fit(x, np.ones(20)).score(x) > 0.5).all() and (fit(x, np.zeros(20)).score(x) < 0.5).all()
    assert (fit(x[:0], np.zeros(0)).score(x) > 0.5).all()


def test_awkward_rows(spark):
    df = awkward(spark)
    lab = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 0, 0), (10, 0, 1), (None, 1, 1), (7, None, None), (6, 1, 0), (6, 0, 0), (777, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.label_id for r in labelled(lab, "quality", 100).collect()} == {1, 2, 3, 9, 10, 777}
    m = train(df, lab)
    out = score_quality(df, m)
    assert out.count() == df.count() and out.filter("score < 0 or score > 1 or score is null").count() == 0
    assert keep_quality(df, m).schema == df.schema
    assert score_quality(empty(spark), m).count() == 0
    assert train(empty(spark), lab.limit(0)).score(np.zeros((2, len(FEATURES)))).min() > 0.5  # without labels all stay


def test_held_out_accuracy_and_query(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no data")
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fit_on, held = lab.filter("doc_id % 3 <> 0"), lab.filter("doc_id % 3 = 0")
    s = score_quality(d, train(d, fit_on)).join(held, "doc_id").toPandas()
    good, bad = s[s.quality == 1], s[s.quality == 0]
    assert (good.score >= KEEP).mean() > 0.98 and (bad.score < KEEP).mean() > 0.9
    kept = entry.queries()["op5_quality"](spark, sf).join(lab, "doc_id").toPandas()
    assert (kept.quality == 1).mean() > 0.98 and len(kept[kept.quality == 1]) > 0.98 * lab.filter("quality = 1").count()


def plainly(text):
    """The features of one text, by the book."""
    data, w = text.encode(), [x.encode() for x in re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())]
    size, one = max(len(data), 1), max(len(w), 1)
    of = lambda marks: sum(chr(c) in marks for c in data if c < 128)
    up, low = of(string.ascii_uppercase), of(string.ascii_lowercase)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return [
        math.log1p(len(w)), sum(map(len, w)) / one, up / max(up + low, 1), of("#$%&*^~{}<>@\\=+_") / size, of("!?") / one, of(".:;") / one, of(string.digits) / size, len(set(w)) / one**0.8, max(map(w.count, set(w)), default=0) / one,
        math.log1p(size / (1 + data.count(b"\n"))), sum(a == b for a, b in zip(w, w[1:])) / one, 1 - len(set(g)) / max(len(g), 1), of(",") / one, sum(c >= 128 for c in data) / size, sum(len(x) <= 2 for x in w) / one, of("|") / one,
    ]


def test_query_against_brute_force(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no data")
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = train(d, lab)
    want = {}
    for r in d.collect():
        x = plainly(r.text or "")
        z = m.bias + sum(t[sum(e <= v for e in edges)] for v, edges, t in zip(x, m.edges, m.tables))
        z += sum(t[sum(e <= x[a] for e in m.coarse[a]), sum(e <= x[b] for e in m.coarse[b])] for a, b, t in m.pairs)
        want[r.doc_id] = 1 / (1 + math.exp(-z))
    have = {r.doc_id: r.score for r in entry.queries()["op5_quality"](spark, sf).collect()}
    assert set(have) == {i for i, s in want.items() if round(s, 6) >= KEEP} and 0 < len(have) < len(want)
    assert all(abs(have[i] - want[i]) < 2e-6 for i in have)

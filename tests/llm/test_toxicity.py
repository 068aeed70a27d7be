import os

import numpy as np
import pyarrow as pa
import pytest
from rows import awkward, empty, passage

from glyphmill.llm.toxicity import STRIDE, WINDOW, fit, score_toxicity, train, windows

BAD = ["wretchedness", "scoundrel", "worthless", "vermin"]


def sample(n, seed, twist=lambda w: w):
    r = np.random.default_rng(seed)
    rows, y = [], []
    for k in range(n):
        w = passage(10_000 * seed + k, int(r.integers(40, 160))).split()
        if k % 3 == 0:
            at = int(r.integers(0, len(w)))
            w[at:at] = [twist(BAD[int(r.integers(len(BAD)))]) for _ in range(5)]
        rows.append(" ".join(w))
        y.append(int(k % 3 == 0))
    return rows, np.array(y)


def test_windows_cover_every_word():
    off = np.array([0, 0, 5, 5 + WINDOW, 5 + WINDOW + 1000])
    row, a, b = windows(off)
    seen = np.zeros(off[-1], bool)
    for x, y in zip(a, b):
        assert 0 < y - x <= WINDOW
        seen[x:y] = True
    assert seen.all() and 0 not in row
    assert (np.diff(a)[np.diff(row) == 0] == STRIDE).all()


def test_held_out_and_misspelt():
    m = fit(*sample(600, 1))
    # without subwords no misspelt word would be known
    for twist, least in ((lambda w: w, 0.9), (str.upper, 0.9), (lambda w: w[:3] + w[2:], 0.75), (lambda w: w[:-3] + w[-2] + w[-3] + w[-1], 0.4)):
        rows, y = sample(300, 2, twist)
        hit = m.score(pa.array(rows)) >= 0.5
        assert hit[y == 1].mean() > least and hit[y == 0].mean() < 0.05


def test_scores_do_not_depend_on_the_batch():
    m = fit(*sample(200, 1))
    rows = sample(20, 3)[0] + ["", None]
    assert np.allclose(m.score(pa.array(rows, pa.string())), [m.score(pa.array([r], pa.string()))[0] for r in rows])


def test_long_texts_are_read_whole():
    m = fit(*sample(600, 1))
    long = passage(77, 20_000)
    assert m.score(pa.array([long + " " + " ".join(BAD * 3)]))[0] >= 0.5


def test_degenerate_labels():
    assert fit(["a b"], np.array([1])).score(pa.array(["a b", ""])).tolist() == [0, 0]
    assert fit([], np.zeros(0)).score(pa.array(["a"])).tolist() == [0]


def test_awkward_rows(spark):
    df = awkward(spark)
    lab = spark.createDataFrame([(k, 1, int(k in (1, 10))) for k in (1, 2, 3, 4, 5, 6, 7, 10, 11, None)], "doc_id long, quality int, toxic int")
    out = score_toxicity(df, train(df, lab)).toPandas()
    assert len(out) == df.count() and out.score.between(0, 1).all()
    assert (out[out.doc_id.isin([3, 4, 5, 6])].score == 0).all()
    assert score_toxicity(empty(spark), train(empty(spark), lab.limit(0))).count() == 0


def test_the_bound_on_bytes(spark):
    """What doesn't fit is passed over, whatever its id, and nothing larger than the bound comes to the driver."""
    rows, y = sample(120, 4)
    rows = [" ".join(rows) * 3] + rows
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(v)) for k, v in enumerate([1, *y])], "doc_id long, toxic int")
    m = train(df, lab, most_bytes=100_000)
    assert len(m.weight) and m.score(pa.array([" ".join(BAD * 2)]))[0] >= 0.5
    with pytest.raises(ValueError):
        train(df, lab, most_bytes=100)


def test_held_out_on_the_tables(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no data")
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    s = score_toxicity(d, train(d, lab.filter("doc_id % 3 <> 0"))).join(lab.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    assert (s[s.toxic == 1].score >= 0.5).mean() > 0.8 and (s[s.toxic == 0].score >= 0.5).mean() < 0.05
    out = entry.queries()["op7_toxicity"](spark, sf).join(lab, "doc_id").toPandas()
    assert (out.toxic == 1).mean() > 0.9 and len(out[out.toxic == 1]) > 0.9 * lab.filter("toxic = 1").count()


def test_query_against_brute_force(spark):
    """Word by word and window by window, in plain Python."""
    import re
    from math import ceil, exp

    import __spark_entry__ as entry
    from glyphmill.llm.toxicity import subwords

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no data")
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = train(d, lab)
    worth = {}

    def word(w):
        if w not in worth:
            worth[w] = float(np.mean(m.weight[subwords(pa.array([w]))[0]]))
            # n-grams of 3 to 5 bytes of the word between its marks, and the word itself
            n = len(w.encode()) + 2
            assert len(subwords(pa.array([w]))[0]) == 1 + sum(max(n - k + 1, 0) for k in (3, 4, 5))
        return worth[w]

    want = {}
    for r in d.collect():
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (r.text or "").lower())
        w = [x for k, x in enumerate(w) if not k or x != w[k - 1]]
        starts = [STRIDE * k for k in range(1 + max(0, ceil((len(w) - WINDOW) / STRIDE)))] if w else []
        z = [sum(map(word, w[a : a + WINDOW])) / len(w[a : a + WINDOW]) + m.bias - m.shift for a in starts]
        want[r.doc_id] = max((1 / (1 + exp(-min(max(x, -50), 50))) for x in z), default=0.0)
    have = {r.doc_id: r.score for r in entry.queries()["op7_toxicity"](spark, sf).collect()}
    assert all(abs(have[i] - want[i]) < 1e-5 for i in have)
    assert {i for i, s in want.items() if s >= 0.50001} <= set(have) <= {i for i, s in want.items() if s >= 0.49999}

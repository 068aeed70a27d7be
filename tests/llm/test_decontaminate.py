import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import awkward, docs, empty, got, passage

from glyphmill.llm.decontaminate import COVERAGE, MIN_MATCH, contamination, decontaminate, tiling

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def greedy(p, q, least):
    """Greedy string tiling as published, by exhaustive search for the longest unmarked match."""
    mp, mq, out = [False] * len(p), [False] * len(q), []
    while True:
        best = None
        for j in range(len(q)):
            for i in range(len(p)):
                n = 0
                while i + n < len(p) and j + n < len(q) and p[i + n] == q[j + n] and not mp[i + n] and not mq[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        mp[i : i + n] = [True] * n
        mq[j : j + n] = [True] * n
        out.append(best)


def brute(docs, items):
    out = []
    for d, text in docs:
        p = WORD.findall((text or "").lower())
        for k, item in items:
            q = WORD.findall((item or "").lower())
            if not {tuple(q[i : i + MIN_MATCH]) for i in range(len(q) - MIN_MATCH + 1)} & {tuple(p[i : i + MIN_MATCH]) for i in range(len(p) - MIN_MATCH + 1)}:
                continue
            tiles = greedy(p, q, MIN_MATCH)
            n = sum(t[2] for t in tiles)
            if tiles and n >= COVERAGE * len(q):
                out.append((d, k, round(n / len(q), 6), len(tiles), n))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 2), max_size=20), st.integers(1, 3))
def test_tiling(p, q, seed):
    ij = [(i, j) for i in range(len(p) - seed + 1) for j in range(len(q) - seed + 1) if p[i : i + seed] == q[j : j + seed]]
    i, j = (np.array([x[k] for x in ij], np.int64) for k in (0, 1))
    assert (tiling(i, j, seed) if ij else []) == greedy(p, q, seed)


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


@pytest.fixture(scope="module")
def case(spark):
    items = [passage(k, 40) for k in range(6)] + [None, "", "too few words"]
    w = [x.split() for x in items[:6]]
    rows = [
        passage(50, 300) + " " + items[0] + " " + passage(51, 200),
        " ".join(w[1][20:] + passage(52, 30).split() + w[1][:20]),  # reordered
        " ".join(w[2][:12] + passage(53, 50).split()),  # too little
        items[3].upper().replace(" ", ", "),
        " ".join(w[4][:14] + ["gap"] + w[4][15:29] + ["gap"] + w[4][30:]),
        passage(54, 400), None, "", items[0], items[0],
    ]
    return docs(spark, rows), bench(spark, items), brute(list(enumerate(rows)), list(enumerate(items)))


def test_against_brute_force(case):
    d, b, want = case
    assert {(0, 0), (1, 1), (3, 3), (4, 4)} <= {x[:2] for x in want} and not any(x[0] in (2, 5) for x in want)
    assert got(contamination(d, b)) == want


def test_the_shuffled_way_is_the_same(case):
    d, b, want = case
    assert got(contamination(d, b, index_bytes=0)) == want


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_items_that_repeat_a_seed(spark, limit):
    items = ["a b c d e " * 20, "x y z " * 15 + passage(80, 6), passage(81, 40), passage(82, 60)]
    rows = [passage(83, 50) + " " + items[0] + passage(84, 50), items[1], "a b c d e " * 9, "a b c d e " * 10, items[2] + " " + items[3]]
    d, b = docs(spark, rows), bench(spark, items).selectExpr("if(item_id = 3, 2L, item_id) AS item_id", "text")  # two items of one id
    want = brute(list(enumerate(rows)), list(zip([0, 1, 2, 2], items)))
    assert {(0, 0), (1, 1), (3, 0), (4, 2)} == {x[:2] for x in want} and len(want) == 5
    assert got(contamination(d, b, index_bytes=limit)) == want


def test_both_ways_on_many_small_texts(spark):
    """Few different words, so that seeds repeat in items and documents; repeated ids and texts on both sides."""
    r = random.Random(6)
    some = lambda n: " ".join(r.choice("la le lu".split()) for _ in range(n))
    items = [(k % 20, some(r.randint(3, 25))) for k in range(30)] + [(3, "la " * 30), (None, some(20)), (4, None)]
    rows = [(k % 50, some(r.randint(0, 40))) for k in range(60)] + [(7, "la " * 30), (8, items[0][1]), (8, items[0][1]), (None, items[1][1])]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute([x for x in rows if x[0] is not None], [x for x in items if x[0] is not None])
    clean = sorted(map(str, [x for x in rows if not brute([(0, x[1])], [y for y in items if y[0] is not None])]))
    assert len(want) > 50 and len(clean) > 5
    for limit in (0, 1 << 26):
        assert got(contamination(d, b, index_bytes=limit)) == want
        assert sorted(str(tuple(x)) for x in decontaminate(d, b, index_bytes=limit).collect()) == clean


def test_columns_with_the_names_of_our_own(case, spark):
    d, b, want = case
    for c in ("bad", "__bad", "tkey", "ikey", "h", "key"):
        d = d.withColumn(c, d["source"])
    for limit in (0, 1 << 26):
        out = decontaminate(d, b, index_bytes=limit)
        assert out.columns == d.columns and {r.doc_id for r in out.collect()} == set(range(10)) - {x[0] for x in want}


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_decontaminate_keeps_the_rest(case, limit):
    d, b, want = case
    kept = {r.doc_id for r in decontaminate(d, b, index_bytes=limit).collect()}
    assert kept == set(range(10)) - {x[0] for x in want}


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_decontaminate_judges_rows_by_their_text(spark, limit):
    item, clean = passage(90, 40), passage(91, 40)
    d = spark.createDataFrame([(1, clean), (1, item), (None, item), (None, clean), (2, clean), (None, None), (3, None)], "doc_id long, text string")
    out = decontaminate(d, bench(spark, [item]), index_bytes=limit).collect()
    assert sorted(map(str, out)) == sorted(str(r) for r in d.collect() if r.text != item)


def test_awkward_rows(spark):
    df, b = awkward(spark), bench(spark, [passage(1, 120), None, "", passage(7, 30)])
    assert {r[0] for r in got(contamination(df, b))} == {1, 2}
    for limit in (0, 1 << 26):
        out = decontaminate(df, b, index_bytes=limit)
        assert out.schema == df.schema
        ids = [r.doc_id for r in out.collect()]
        assert 1 not in ids and 2 not in ids and {3, 4, 5, 6, 7, 8, 9} <= set(ids)
    assert contamination(empty(spark), b).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(df, none).count() == 0 and decontaminate(df, none).count() == df.count()


def test_query_against_brute_force(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no data")
    d = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    b = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(entry.queries()["op3_decontamination"](spark, sf)) == brute(d, b)

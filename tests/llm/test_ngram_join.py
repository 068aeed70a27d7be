import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import awkward, docs, empty, got, passage

from glyphmill.llm.ngram_join import SLOTS, THRESHOLD, drop_similar, gram_sets, similar_classes, trie_join

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def grams(text, n=3):
    w = WORD.findall((text or "").lower())
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def similar(rows):
    """All pairs of documents, by comparing all sets."""
    s = [(i, grams(t)) for i, t in rows]
    return [(x, y) for (x, (i, a)), (y, (j, b)) in combinations(enumerate(s), 2) if (i, a) != (j, b) and a and b and len(a & b) >= THRESHOLD * len(a | b) - 1e-12]


def brute(rows):
    """(doc_id, class_id, links) of distinct documents."""
    rows = list({(i, frozenset(grams(t))): (i, t) for i, t in rows}.values())
    root = list(range(len(rows)))
    links = [0] * len(rows)
    for x, y in similar(rows):
        links[x] += 1
        links[y] += 1
        a, b = root[x], root[y]
        root = [a if v == b else v for v in root]
    return sorted((rows[k][0], min(rows[x][0] for x in range(len(rows)) if root[x] == root[k]), links[k]) for k in range(len(rows)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=9).map(" ".join), max_size=5))
def test_gram_sets(rows):
    g, off = gram_sets(pa.array(rows, pa.string()))
    assert np.diff(off).tolist() == [len(grams(r)) for r in rows]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=14), st.sampled_from([0.3, 0.5, 0.8, 1.0]), st.booleans())
def test_trie_join(sets, t, same):
    arrays = [np.array(sorted(s), np.uint64) << np.uint64(50) for s in sets]
    ids = np.arange(len(sets))
    left, right = (ids, ids) if same else (ids[::2], ids[1::2])
    if not len(left) or not len(right):
        return
    want = sorted((int(x), int(y), len(sets[x] & sets[y])) for x in left for y in right if x != y and len(sets[x] & sets[y]) >= t * len(sets[x] | sets[y]) - 1e-9)
    assert sorted(trie_join(arrays, left, right, t, np.random.default_rng(len(sets)).integers(0, 9, SLOTS).astype(np.uint8))) == want


def family(n=5):
    rows = []
    for k in range(n):
        b = passage(k, 300).split()
        rows.append(" ".join(b))
        for step in (70, 40, 20):
            rows.append(" ".join(f"z{k}" if i % step == 3 else w for i, w in enumerate(b)))
    return rows


def test_classes_match_brute_force(spark):
    rows = family() + [passage(0, 300), "two words", "two  Words", "", None, passage(70, 200), "a b c", "a b c d", "b c d", "q r s t u", "q r s t"]
    want = brute(list(enumerate(rows)))
    have = got(similar_classes(docs(spark, rows)))
    assert have == want and sum(x[2] for x in want) > 20 and len({x[1] for x in want}) > 5
    assert have == got(similar_classes(docs(spark, rows), tile=3))


def test_texts_under_one_id(spark):
    rows = [(1, passage(0, 50)), (1, passage(1, 50)), (2, passage(1, 50) + " x"), (3, passage(0, 50)), (3, passage(0, 50)), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(similar_classes(df)) == brute(rows)
    assert sorted((r.doc_id, r.text or "") for r in drop_similar(df).collect()) == sorted((i, t or "") for i, t in [rows[0], rows[1], rows[5]])


def test_one_of_each_group_stays(spark):
    rows = family(3) + [passage(0, 300), "", "", None]
    kept = sorted(r.doc_id for r in drop_similar(docs(spark, rows)).collect())
    assert kept == sorted({x[1] for x in brute(list(enumerate(rows)))})


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = got(similar_classes(df))
    assert rows == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 1), (8, 7, 1), (9, 9, 0), (10, 10, 0), (11, 11, 0)]
    out = drop_similar(df)
    assert out.schema == df.schema
    ids = [r.doc_id for r in out.collect()]
    assert 2 not in ids and 8 not in ids and ids.count(None) == 2 and ids.count(1) == 2 and {3, 4, 5, 6, 7, 9, 10, 11} <= set(ids)
    assert similar_classes(empty(spark)).count() == 0 and drop_similar(empty(spark)).count() == 0


def test_passages_in_common_do_not_tie(spark):
    shared = passage(500, 60)
    rows = [passage(600 + k, 150) + " " + shared for k in range(20)]
    assert got(similar_classes(docs(spark, rows))) == [(k, k, 0) for k in range(20)]


def test_columns_with_the_names_of_our_own(spark):
    df = docs(spark, [passage(3, 60), passage(3, 60) + " y", passage(4, 60)])
    for c in ("gone_id", "GONE_KEY", "sid", "node", "comp", "class_id", "of", "__gone"):
        df = df.withColumn(c, df["source"])
    out = drop_similar(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [0, 2]

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import awkward, docs, empty, got, passage

from glyphmill.llm.repeats import bounded_lcp, repeated, repeated_passages, suffix_order

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def brute(rows, length):
    """Passages by counting every window; rows of equal id and text are one place."""
    words = {(i, t): WORD.findall((t or "").lower()) for i, t in rows if i is not None}
    count = {}
    for w in words.values():
        for k in range(len(w) - length + 1):
            win = tuple(w[k : k + length])
            count[win] = count.get(win, 0) + 1
    out = []
    for (i, _), w in words.items():
        spans = []
        for k in range(len(w) - length + 1):
            if count[tuple(w[k : k + length])] > 1:
                if spans and k <= spans[-1][1] + 1:
                    spans[-1][1] = k + length - 1
                else:
                    spans.append([k, k + length - 1])
        out += [(i, a, b) for a, b in spans]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 9))
def test_bounded_lcp(symbols, bound):
    s = np.array(symbols + [9])
    order = suffix_order(s, len(s) + 1)
    lcp = bounded_lcp(s, order, bound)
    rest = [tuple(s[i:]) for i in order]
    assert rest == sorted(rest)
    for k in range(1, len(s)):
        n = 0
        while n < min(len(rest[k]), len(rest[k - 1])) and rest[k][n] == rest[k - 1][n]:
            n += 1
        assert min(n, bound) == lcp[k]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=15), min_size=1, max_size=5), st.integers(1, 6))
def test_repeated(parts, bound):
    s = np.concatenate([[*p, 100 + k] for k, p in enumerate(parts)]).astype(np.int64)
    have = repeated(s, bound)
    for i in range(len(s) - bound + 1):
        win = s[i : i + bound].tolist()
        many = sum(s[j : j + bound].tolist() == win for j in range(len(s) - bound + 1)) > 1
        assert have[i] == many


def case():
    shared, other = passage(1, 90).split(), passage(2, 50).split()
    f = lambda k, n: passage(100 + k, n).split()
    rows = [
        f(1, 80) + shared + f(2, 70), f(3, 10) + shared[20:] + f(4, 99), shared[:49] + f(5, 30),
        other + f(6, 20) + other, ["same"] * 130, f(7, 200), f(7, 200), [], shared[10:75],
    ]
    return [" ".join(r) for r in rows] + [None]


def test_against_brute_force(spark):
    rows = case()
    want = brute(list(enumerate(rows)), 50)
    assert {x[0] for x in want} == {0, 1, 3, 4, 5, 6, 8}
    assert got(repeated_passages(docs(spark, rows))) == want
    assert got(repeated_passages(docs(spark, rows), chunk=1)) == want


def test_short_bounds(spark):
    rows = ["a b a b a b c", "b c d a b", "x y", "a a a a a a"]
    assert got(repeated_passages(docs(spark, rows), length=3, gram=2)) == brute(list(enumerate(rows)), 3)


def test_awkward_rows(spark):
    df = awkward(spark)
    have = got(repeated_passages(df))
    assert have == brute([(r.doc_id, r.text) for r in df.collect()], 50)
    assert {x[0] for x in have} == {1, 2, 7, 8, 11}
    assert repeated_passages(empty(spark)).count() == 0


def test_two_texts_under_one_id(spark):
    p = passage(3, 60)
    df = spark.createDataFrame([(1, p), (1, "more " + p), (2, passage(4, 60))], "doc_id long, text string")
    assert got(repeated_passages(df)) == [(1, 0, 59), (1, 1, 60)]


def test_a_hot_anchor_in_parts(spark):
    """One passage in very many documents, with other words around it each time, and in part only in some."""
    p = passage(9, 70).split()
    r = lambda k, n: passage(300 + k, n).split()
    rows = [" ".join(r(2 * k, 40) + (p if k % 4 else p[:58] if k % 8 else p[5:]) + r(2 * k + 1, 40)) for k in range(60)]
    want = brute(list(enumerate(rows)), 50)
    assert len({x[0] for x in want}) == 60 and len({x[2] - x[1] for x in want}) > 2
    for chunk in (1 << 19, 500):
        assert got(repeated_passages(docs(spark, rows), chunk=chunk)) == want

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import awkward, docs, empty, got, passage

from glyphmill.llm.line_dedup import LONG, U, cut, dedup_lines, extended, grams, lines, minima, repeated_runs, winnow

SPACES = " \t\r\v\f"


def solid(text):
    return [s for s in (x.strip(SPACES) for x in (text or "").split("\n")) if s]


def brute(rows, t=2, long=LONG):
    """Runs to delete, by looking at every window of t lines, and every long line, of every document in order."""
    seen, out = set(), []
    for d, text in sorted(rows):
        own, drop = solid(text), set()
        for i in range(len(own)):
            for win in (tuple(own[i : i + t]) if i + t <= len(own) else None, own[i] if len(own[i].encode()) >= long else None):
                if win is None:
                    continue
                if win in seen:
                    drop |= set(range(i, i + (t if isinstance(win, tuple) else 1)))
                seen.add(win)
        for i in sorted(drop):
            if i - 1 in drop:
                out[-1] = (d, out[-1][1], i)
            else:
                out.append((d, i, i))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t", max_size=20), max_size=6))
def test_lines(rows):
    h, off, size = lines(pa.array(rows, pa.string()))
    want = [solid(r) for r in rows]
    assert [int(b - a) for a, b in zip(off, off[1:])] == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert size.tolist() == [len(x) for x in flat]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=4), st.integers(1, 3), st.integers(1, 4))
def test_fingerprints_are_window_minima_and_extend_to_whole_windows(rows, k, w):
    h, off, size = lines(pa.array(["\n".join(r) for r in rows]))
    row, line, fp, start, count, around, to = winnow(h, off, size, k, w, 100)
    g, at = grams(h, off, k)
    chosen = {(r, int(p)) for r, _, p in zip(*minima(g, at, w))}
    assert sorted(chosen) == sorted((r, int(at[r] + x)) for r, x in zip(row, line))
    t = k + w - 1
    own, off_in, match = extended(fp, count, around, to, t)
    places = [(int(row[o]), int(start[o] + x)) for o, x in zip(own, off_in)]
    assert sorted(places) == [(r, p) for r, x in enumerate(rows) for p in range(len(x) - t + 1)]
    win = [tuple(rows[r][p : p + t]) for r, p in places]
    for i in range(len(win)):
        for j in range(i):
            assert (match[i] == match[j]) == (win[i] == win[j])


def test_few_lines_are_selected():
    rows = ["\n".join(passage(k, 400).split()) for k in range(20)]
    h, off, size = lines(pa.array(rows))
    for w in (2, 4, 9):
        n = len(winnow(h, off, size, 1, w, 1000)[0])
        assert abs(n / len(h) - 2 / (w + 1)) < 0.04


@pytest.mark.parametrize("window", [2, 3, 5])
def test_against_brute_force(spark, window):
    block = [f"line {k} of the block" for k in range(6)]
    notice = "this notice of sixty-four bytes or more stands alone between other lines"
    rows = [
        "\n".join(["start", *block, "end"]),
        "\n".join(["other", *(f"  {x}\t" for x in block[1:5]), "rest"]),
        "\n".join([block[0], "between", block[1]]),
        "\n".join(["x", "y", "q", "x", "y", "q", "x", "y"]),
        "\n".join(block), "same\nsame\nsame\nsame", None, "", "a\n\n\nb", "a\nb",
        f"one\n{notice}\ntwo", f"three\n {notice}\nfour", notice, "same\nsame\nsame\nsame\nsame\nsame",
    ]
    want = brute(list(enumerate(rows)), window)
    df = docs(spark, rows)
    assert got(repeated_runs(df, window=window)) == sorted(want)
    assert (11, 1, 1) in want and (12, 0, 0) in want
    out = {r.doc_id: r for r in dedup_lines(df, window=window).collect()}
    for d, text in enumerate(rows):
        drop = {i for k, a, b in want if k == d for i in range(a, b + 1)}
        left = [x for i, x in enumerate(solid(text)) if i not in drop]
        if drop and not left:
            assert d not in out
        else:
            assert solid(out[d].text) == left
            assert text is None or out[d].n_chars == len(out[d].text)


def test_cut():
    assert cut("a\n\nb\nc", [(0, 2)]) == "\nc"
    assert cut("a\nb", [(0, 2)]) is None
    assert cut("a\nb\nc", [(1, 1)]) == "a\nc"


def test_awkward_rows(spark):
    df = awkward(spark)
    many = df.withColumn("text", __import__("pyspark").sql.functions.expr("concat(text, '\\n', text, '\\n', text, '\\n', text)"))
    assert got(repeated_runs(many))
    out = dedup_lines(df)
    ids = [r.doc_id for r in out.collect()]
    # the copy in document 2 is one long line, so nothing of it is left
    assert out.schema == df.schema and sorted(i for i in ids if i is not None) == [1, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11] and ids.count(None) == 2
    assert dedup_lines(many).schema == df.schema
    assert repeated_runs(empty(spark)).count() == 0 and dedup_lines(empty(spark)).count() == 0


def test_columns_with_the_names_of_our_own(spark):
    df = docs(spark, ["a b\nc d", "a b\nc d\ne"])
    for c in ("doc", "TKEY", "runs", "fp", "start", "lines", "__qd", "__qt", "match"):
        df = df.withColumn(c, df["source"])
    out = dedup_lines(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == {0: "a b\nc d", 1: "e"}


def test_repeated_rows_are_one_document(spark):
    text = "a b c\nd e f\ng h i"
    df = docs(spark, [text]).union(docs(spark, [text])).union(docs(spark, [passage(1, 9), "u\n" + text]).filter("doc_id = 1"))
    assert got(repeated_runs(df)) == [(1, 1, 3)]

import math
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rows import awkward, empty, got

from glyphmill.llm import mixing
from glyphmill.llm.mixing import mix_documents, mix_sources, pivotal, uniform


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0.01, 0.99), max_size=30), st.integers(0, 999))
def test_pivotal_keeps_the_sum(p, seed):
    won, rest, q = pivotal(list(range(len(p))), p, seed)
    assert len(won) == len(set(won)) and abs(len(won) + q - sum(p)) < 1e-6
    assert q < 1 and (q < 1e-8 or rest not in won)


def test_pivotal_keeps_expectations():
    p = [0.2, 0.7, 0.55, 0.35, 0.9, 0.3]
    n, hits = 6000, np.zeros(6)
    for seed in range(n):
        won, rest, q = pivotal(list(range(6)), p, seed)
        hits[won] += 1
        if q > 1e-9 and uniform(seed, rest, 77) < q:
            hits[rest] += 1
    assert np.abs(hits / n - p).max() < 0.03


def corpus(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('ab ', cast(10 + id % 7 as int))").alias("text"), F.expr("case when id % 10 < 7 then 'big' when id % 10 < 9 then 'mid' else 'small' end").alias("source"))


def brute(rows, weights=None, temperature=0.5, budget=None):
    """(expected copies of each document, by source), from the definition."""
    mass = defaultdict(float)
    for _, t, s in rows:
        mass[s] += len(t or "")
    w = {s: (weights.get(s, 0.0) if weights is not None else m**temperature) for s, m in mass.items()}
    total, whole = sum(w.values()), budget if budget is not None else sum(mass.values())
    return {s: (0.0 if not total else w[s] / total * whole / mass[s]) if mass[s] else float(weights is None or w[s] > 0) for s in mass}


def holds(rows, out, **kw):
    want, by = brute(rows, **kw), defaultdict(list)
    for d, s, e, c in out:
        assert abs(e - want[s]) < 1e-6 and math.floor(e - 1e-9) <= c <= math.ceil(e + 1e-9)
        by[s].append((d, e, c))
    for own in by.values():
        one = {d: (e, c) for d, e, c in own}
        assert abs(sum(c for _, c in one.values()) - sum(e for e, _ in one.values())) < 1 + 1e-5


def test_targets_are_met(spark):
    df = corpus(spark)
    rows = [tuple(r) for r in df.collect()]
    for kw in ({}, {"weights": {"big": 0.2, "small": 0.8}}, {"budget": 20_000.0}):
        out = mix_sources(df, **kw).collect()
        assert len(out) == len(rows)
        holds(rows, [tuple(r) for r in out], **kw)
    shares = dict(mix_sources(df, {"big": 0.2, "small": 0.8}).join(df.select("doc_id", F.length("text").alias("n")), "doc_id").groupBy("source").agg(F.sum(F.col("n") * F.col("copies"))).collect())
    assert abs(shares["small"] / (shares["small"] + shares["big"]) - 0.8) < 0.01 and shares["mid"] == 0


def test_the_tree_has_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "FAN", 4)
    df = corpus(spark)
    rows = [tuple(r) for r in df.collect()]
    out = got(mix_sources(df))
    holds(rows, out)
    assert out == got(mix_sources(df.repartition(7)))  # a repeated task decides alike


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect() if r.doc_id is not None]
    out = [tuple(r) for r in mix_sources(df).collect()]
    assert len(out) == len(rows)
    mass = brute(rows)
    assert all(abs(e - mass[s]) < 1e-6 for _, s, e, _ in out)
    docs = mix_documents(df)
    assert docs.columns == [c for c in df.columns if c != "copies"] + ["copies"]
    assert [r.copies for r in docs.filter("doc_id is null").collect()] == [1, 1]
    assert docs.filter("copies < 1").count() == 0
    assert mix_sources(empty(spark)).count() == 0 and mix_documents(empty(spark)).count() == 0
    assert mix_sources(df, {}).agg(F.sum("copies")).first()[0] == 0


def test_query_meets_its_targets(spark):
    import os

    import pytest

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no data")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    out = [tuple(r) for r in entry.queries()["op10_mix_sources"](spark, sf).collect()]
    assert sorted(x[0] for x in out) == sorted(r[0] for r in rows)
    holds(rows, out)


def test_columns_with_the_names_of_our_own(spark):
    df = corpus(spark, 40)
    for c in ("drawn_id", "DRAWN_SOURCE", "drawn_copies", "__qd", "__qs", "__qn", "td", "extra", "of"):
        df = df.withColumn(c, df["source"])
    out = mix_documents(df)
    assert out.columns == [*df.columns, "copies"]
    assert {r.doc_id: r.copies for r in out.collect()} == {r.doc_id: r.copies for r in mix_sources(df).collect() if r.copies}

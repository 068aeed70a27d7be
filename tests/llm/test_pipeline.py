"""Every stage against brute force on its own input, then all of them as one query."""

import os

import pytest
import test_decontaminate
import test_line_dedup
import test_mixing
import test_ngram_join
from rows import awkward, got

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no data")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns[: len(columns)] == columns
        out.write.parquet(path := str(tmp_path / f"{k}"))
        steps.append((docs, docs := spark.read.parquet(path)))
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(text(steps[0][1]))
    assert sum(labels[d] for d in kept & set(labels)) >= 0.98 * sum(labels.values())
    assert sum(1 for d, q in labels.items() if not q and d not in kept) >= 0.9 * sum(1 for q in labels.values() if not q)

    before, after = map(text, steps[1])
    runs = test_line_dedup.brute(list(before.items()))
    drop = {}
    for d, a, b in runs:
        drop.setdefault(d, set()).update(range(a, b + 1))
    want = {d: [x for i, x in enumerate(test_line_dedup.solid(t)) if i not in drop.get(d, ())] for d, t in before.items()}
    assert {d: test_line_dedup.solid(t) for d, t in after.items()} == {d: x for d, x in want.items() if x or d not in drop}

    before, after = map(text, steps[2])
    assert set(after) == {c for _, c, _ in test_ngram_join.brute(list(before.items()))} and all(before[d] == t for d, t in after.items())

    before, after = map(text, steps[3])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(after) == set(before) - {x[0] for x in test_decontaminate.brute(list(before.items()), items)}

    source, mixed = steps[4]
    expected = test_mixing.brute([(r.doc_id, r.text, r.source) for r in source.collect()])
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    for s, e in expected.items():
        own = [copies.get(r.doc_id, 0) for r in source.filter(source["source"] == s).collect()]
        assert abs(sum(own) - e * len(own)) < 1 + 1e-5 and all(int(e - 1e-6) <= c <= e + 1 for c in own)

    key = lambda df: got(df.select("doc_id", "text", "source", "n_chars", "copies"))
    assert key(cp.run(spark, SF)) == key(mixed)


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no data")
    docs = awkward(spark).drop("copies")
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        assert [c for c in out.columns if c != "copies"] == docs.columns
        out.write.parquet(path := str(tmp_path / f"{k}"))
        docs = spark.read.parquet(path)


def test_an_empty_table_passes_every_stage(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no data")
    docs = awkward(spark).drop("copies").limit(0)
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / f"{k}"))
        docs = spark.read.parquet(path)
        assert docs.count() == 0

"""Ranking operators against hand-worked cases and a loop of plain Python."""

import random

import numpy as np
import pytest

from glyphmill.operators import bm25, boosts, chunking, dense, fusion, lookup
from glyphmill.operators.rerank import rerank
from glyphmill.plans import search


def toks(spark, docs):
    return bm25.chunk_terms(spark.createDataFrame([(i, " ".join(d), "x") for i, d in enumerate(docs)], "chunk_id long, content string, file_path string"), enriched=False)


def asked(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")


def test_bm25(spark):
    ix = bm25.build(toks(spark, [["hello", "world"], ["hello"], ["world"], []]))
    c = ix.corpus.first()
    assert (c.n, c.avgdl) == (4, 1.0)
    got = {(r.query_id, r.chunk_id): r.score for r in bm25.scores(ix, asked(spark, "hello", "hello hello", "nothing")).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (1, 1)} and got[0, 0] == got[1, 0] > 0
    import math

    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    assert got[0, 1] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 1)), rel=1e-6)


def test_bm25_empty(spark):
    ix = bm25.build(toks(spark, []))
    assert ix.corpus.first().avgdl == 0.0
    assert bm25.scores(ix, asked(spark, "x")).count() == 0


@pytest.mark.parametrize("filtered", [False, True])
def test_best_is_the_top_of_all_scores(spark, filtered):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gammaRay delta_two eps zeta eta theta".split())
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 12))), f"{'src' if i % 3 else 'pkg'}/f.py", "go" if i % 2 else None) for i in range(300)], "chunk_id long, content string, file_path string, language string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 5))), ["go"] if i % 2 else None, ["src"] if i % 3 == 0 else []) for i in range(12)], "query_id long, text string, filter_languages array<string>, filter_paths array<string>")
    ix = bm25.build(bm25.chunk_terms(docs))
    meta = docs if filtered else None
    want = sorted(map(tuple, bm25.best(ix._replace(counted=None), q, 4, chunks=meta).collect()))
    assert want and {len([x for x in want if x[0] == i]) for i in range(12)} <= {0, 4}
    for size in (1 << 20, 1):
        assert sorted(map(tuple, bm25.best(ix, q, 4, chunks=meta, query_bytes=size).collect())) == want


def test_scores_are_added_up_where_chunks_are(spark):
    """The same scores as by a join of postings, in one block or many, without shuffling pairs."""
    rng = random.Random(6)
    word = lambda: rng.choice("alpha beta gammaRay delta_two eps zeta eta theta".split())
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 12))), "f.py") for i in range(300)], "chunk_id long, content string, file_path string").repartition(3)
    q = spark.createDataFrame([(None if i == 3 else i, " ".join(word() for _ in range(rng.randint(0, 5)))) for i in range(12)] + [(20, None)], "query_id long, text string")
    ix = bm25.build(bm25.chunk_terms(docs))
    rows = lambda df: {(r.query_id, r.chunk_id): r.score for r in df.collect()}
    want = rows(bm25.scores(ix._replace(counted=None), q))
    assert len(want) > 1000
    for size in (1 << 20, 1):
        found = bm25.scores(ix, q, size)
        assert rows(found) == pytest.approx(want, rel=1e-6) and found.count() == len(want)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    # queries that share an id count as one
    twice = q.union(q)
    assert rows(bm25.scores(ix, twice)) == rows(bm25.scores(ix._replace(counted=None), twice))
    assert bm25.scores(ix, q.filter("query_id < 0")).count() == 0


def test_workers_hold_slices_and_few_tokens(spark):
    """A worker's memory doesn't follow the number of different tokens, nor of the rows of a batch beyond the batch itself."""
    import tracemalloc

    from glyphmill.functions import tokens

    tokens._known.clear()
    tracemalloc.start()
    for i in range(200):
        tokens.term_counts(" ".join(f"word{i}x{j}" for j in range(1000)))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 16 << 20
    counted = toks(spark, [["hello", "world"]] * 3 + [["world"]] * 6000)
    assert bm25._frequencies(counted.coalesce(1), bm25.pa.array(["hello", "none", "world"])).tolist() == [3, 0, 6003]
    index = bm25.build(counted.coalesce(1))
    assert {r.chunk_id for r in bm25.best(index, asked(spark, "hello"), 9).collect()} == {0, 1, 2} and bm25.scores(index, asked(spark, "world")).count() == 6003


def test_rrf_and_blend(spark):
    s = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.9), (0, 2, 0.5)], "query_id long, chunk_id long, score double")
    got = {r.chunk_id: r.rrf for r in fusion.rrf_rank(s).collect()}
    assert got == {0: 1 / 63, 1: 1 / 61, 2: 1 / 62}
    sem = spark.createDataFrame([(0, 7, 1)], "query_id long, chunk_id long, sem_rank int")
    lex = spark.createDataFrame([(0, 8, 1)], "query_id long, chunk_id long, bm_rank int")
    q = spark.createDataFrame([(0, 0.5)], "query_id long, alpha double")
    meta = spark.createDataFrame([(7, "late", 100), (8, "early", 1)], "chunk_id long, file_path string, start_line long")
    c = fusion.candidates(fusion.blend(sem, lex, q), meta).orderBy("ord").collect()
    assert [r.chunk_id for r in c] == [8, 7] and c[0].score == c[1].score == 0.5 / 61


def cands(spark, rows):
    return spark.createDataFrame([(0, i, p, float(s), i) for i, (p, s) in enumerate(rows)], "query_id long, chunk_id long, file_path string, score double, ord long")


def test_coherence(spark):
    got = [r.score for r in boosts.file_coherence(cands(spark, [("a.ts", 0.5), ("a.ts", 0.4), ("a.ts", 0.3), ("b.ts", 0.2)])).orderBy("ord").collect()]
    assert got == pytest.approx([0.6, 0.4, 0.3, 0.2 + 0.1 * 0.2 / 1.2])
    assert [r.score for r in boosts.file_coherence(cands(spark, [("a", 1.0), ("a", -1.0)])).orderBy("ord").collect()] == [1.0, -1.0]


def boosted(spark, query, cand, chunks):
    spec = boosts.query_spec(spark.createDataFrame([(0, query, None)], "query_id long, text string, alpha double"))
    c = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(chunks)], "chunk_id long, content string, file_path string")
    rows = boosts.query_boost(cands(spark, []).union(spark.createDataFrame([(0, i, chunks[i][1], s, i) for i, s in cand], "query_id long, chunk_id long, file_path string, score double, ord long")), spec, c)
    return {r.chunk_id: r.score for r in rows.collect()}


def test_definitions(spark):
    assert boosted(spark, "HandlerStack", [(0, 0.5), (1, 1.0)], [("class HandlerStack:", "other.py"), ("x", "y.py")])[0] == pytest.approx(3.5)
    assert boosted(spark, "HandlerStack", [(0, 0.5)], [("class HandlerStack:", "handler_stack.py")])[0] == pytest.approx(2.75)
    assert boosted(spark, "HandlerStack", [(1, 1.0)], [("class HandlerStack:", "handler_stack.py"), ("x", "y.py")]) == pytest.approx({0: 4.5, 1: 1.0})
    got = boosted(spark, "where does the StateManager initialize state", [(0, 1.0)], [("class StateManager:", "state_manager.py")])
    assert got[0] >= 3.25
    assert boosted(spark, "find the cache layer", [(0, 1.0)], [("x", "cache_layer.py")])[0] == pytest.approx(1 + 2 / 3)


def test_rerank(spark):
    top = lambda rows, k, p=True: [(r.chunk_id, round(r.score, 9)) for r in rerank(cands(spark, rows), k, p).orderBy("rank").collect()]
    assert top([("a", 1.0)] * 4, 4) == [(0, 1.0), (1, 0.5), (2, 0.25), (3, 0.125)]
    assert [s for _, s in top([("a", 1), ("a", 1), ("b", 1), ("b", 1)], 4)] == [1, 1, 0.5, 0.5]
    assert [i for i, _ in top([("a", 0.5), ("b", 0.9), ("c", 0.1)], 2)] == [1, 0]
    assert top([("tests/a.py", 0.9), ("b.py", 0.5)], 2) == [(1, 0.5), (0, 0.27)]
    assert top([("tests/a.py", 0.9), ("b.py", 0.5)], 2, False) == [(0, 0.9), (1, 0.5)]


def greedy(rows, k):
    """The loop that the windows stand for."""
    taken, out = {}, []
    for i in sorted(range(len(rows)), key=lambda i: -rows[i][1]):
        if len(out) >= k and rows[i][1] <= min(s for s, _ in out):
            break
        n = taken.get(rows[i][0], 0)
        out.append((rows[i][1] * 0.5**n, i))
        taken[rows[i][0]] = n + 1
    return [i for _, i in sorted(out, key=lambda x: -x[0])[:k]]


def test_rerank_is_the_greedy_loop(spark):
    rng = random.Random(3)
    cases = [[(f"f{rng.randint(0, 3)}", rng.randint(0, 6) / 4) for _ in range(rng.randint(1, 14))] for _ in range(80)]
    df = spark.createDataFrame([(q, i, p, s, i) for q, c in enumerate(cases) for i, (p, s) in enumerate(c)], "query_id long, chunk_id long, file_path string, score double, ord long")
    got = {}
    for r in rerank(df, 4, False).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert all(got[q] == greedy(c, 4) for q, c in enumerate(cases))


def test_knn(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((60, 8)).round(1)
    m[7] = m[3]
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "chunk_id long, v array<float>").repartition(3)
    q = v.filter("chunk_id < 10").selectExpr("chunk_id as query_id", "v")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {i: [int(j) for j in np.lexsort((np.arange(60), -np.round(u[i] @ u.T, 6)))[:5]] for i in range(10)}
    for size in (1 << 20, 64):  # one pass or many
        got = {}
        for r in dense.knn(v, q, 5, query_bytes=size).orderBy("query_id", "sem_rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want
    # every query with a filter of its own, some without, in one block or many
    meta = spark.createDataFrame([(i, f"{'src' if i % 3 else 'pkg'}/f{i}.x", None if i % 4 == 0 else "go") for i in range(60)], "chunk_id long, file_path string, language string")
    rule = {0: (None, None), 1: ([], ["src/"]), 2: (["go"], None), 3: ([""], ["pkg", "f8"]), 4: (["none"], None)}
    f = spark.createDataFrame([(i, *rule[i % 5], [float(x) for x in m[i]]) for i in range(10)], "query_id long, filter_languages array<string>, filter_paths array<string>, v array<float>")

    def free(q, i):
        langs, parts = rule[q % 5]
        return (not langs or ("" if i % 4 == 0 else "go") in langs) and (not parts or any(p in f"{'src' if i % 3 else 'pkg'}/f{i}.x" for p in parts))

    pairs = sorted((q, i) for q in range(10) for i in range(60) if free(q, i))
    for size in (1 << 20, 100):
        got = {}
        for r in dense.knn(v, f, 5, meta, query_bytes=size).orderBy("query_id", "sem_rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        near = {i: [int(j) for j in np.lexsort((np.arange(60), -np.round(u[i] @ u.T, 6))) if free(i, j)][:5] for i in range(10)}
        assert got == {i: x for i, x in near.items() if x}
        assert sorted(tuple(r) for r in lookup.selected(meta, f, query_bytes=size).collect()) == pairs
        assert {r.query_id for r in lookup.selected(meta, f, query_bytes=size, once=True).collect()} == {q for q, _ in pairs}
    all_pairs = f.select("query_id").crossJoin(meta.select("chunk_id"))
    assert sorted(tuple(r) for r in lookup.passing(all_pairs, f, meta).collect()) == pairs
    with pytest.raises(ValueError):
        dense.knn(v, q, 0)
    with pytest.raises(ValueError):
        dense.knn(v, spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "query_id long, v array<float>"), 2)


def test_many_queries_in_blocks(spark):
    """More queries than a block holds: the driver holds one block, and products stay small."""
    rng = np.random.default_rng(2)
    m = rng.standard_normal((3000, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "chunk_id long, v array<float>")
    got = {(r.query_id, r.sem_rank): r.chunk_id for r in dense.knn(v, v.selectExpr("chunk_id as query_id", "v"), 3, query_bytes=96 * 900).collect()}
    u = dense.unit(m.astype(np.float64))
    s = np.round(u @ u.T, 12)
    want = np.lexsort((np.broadcast_to(np.arange(3000), s.shape), -s), axis=1)[:, :3]
    assert all(got[i, r + 1] == want[i, r] for i in range(3000) for r in range(3))


def test_knn_within(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "chunk_id long, v array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, v array<float>")
    pool = lambda *rows: spark.createDataFrame(rows, "query_id long, chunk_id long")
    got = sorted((r.query_id, r.sem_rank, r.chunk_id) for r in dense.knn_within(v, q, pool((7, 2), (7, 1), (7, 1), (8, 0)), 5).collect())
    assert got == [(7, 1, 1), (7, 2, 2), (8, 1, 0)]
    with pytest.raises(ValueError):
        dense.knn_within(v, q, pool((7, 3)), 5)


def test_pools_of_any_form_are_the_nearest_by_brute_force(spark):
    """Pools as pairs and as keys, in one block or many, with ties, repeated queries and pairs, and rows that are null."""
    rng = np.random.default_rng(4)
    m = rng.standard_normal((400, 6)).round(1).astype(np.float32)
    m[9] = m[30] = m[2]
    v = spark.createDataFrame([(i, [float(x) for x in r], i % 7) for i, r in enumerate(m)] + [(900, None, 2), (901, [1.0] * 6, None)], "chunk_id long, v array<float>, key long").repartition(3)
    q = v.filter("chunk_id % 5 = 0 and chunk_id < 900").selectExpr("chunk_id as query_id", "v", "key")
    more = q.union(spark.createDataFrame([(5, [0.5] * 6, 5), (1, None, 1), (3, [1.0] * 6, None)], q.schema))
    sim = np.round(dense.unit(m.astype(np.float64)) @ dense.unit(np.vstack([m, np.full((1, 6), 0.5)]).astype(np.float64)).T, 12)
    want = {}
    for i in range(0, 400, 5):
        pairs = sorted((-s, c) for col in ([i, 400] if i == 5 else [i]) for c, s in enumerate(sim[:, col]) if c % 7 == i % 7)
        want[i] = [c for _, c in pairs[:4]]
    pool = more.select("query_id", "key").distinct().join(v.select("chunk_id", "key"), "key").filter("query_id <> 1").select("query_id", "chunk_id")
    pool = pool.union(pool.limit(50)).union(spark.createDataFrame([(77, 3)], pool.schema))
    for size in (1 << 20, 300):
        for found in (dense.knn_by_key(v, more, 4, size), dense.knn_within(v.drop("key"), more.drop("key"), pool, 4, size)):
            got = {}
            for r in found.orderBy("query_id", "sem_rank").collect():
                got.setdefault(r.query_id, []).append(r.chunk_id)
            assert got.keys() - {3} == want.keys() and all(got[i] == x for i, x in want.items())
    with pytest.raises(ValueError):
        dense.knn_by_key(v, q, 0)
    none = q.filter("query_id < 0")
    assert dense.knn_by_key(v, none, 2).count() == dense.knn_within(v, none, pool, 2).count() == 0


def test_best_cuts_down_what_it_holds():
    rng = np.random.default_rng(5)
    best = dense.Best(3, 4)
    best.most = 50
    at, sim, cid = rng.integers(0, 3, 1000), rng.integers(0, 40, 1000) / 40, rng.permutation(1000)
    for a in range(0, 1000, 30):
        best.most = 50
        best.add(at[a : a + 30], sim[a : a + 30], cid[a : a + 30])
        assert best.size <= 80
    got = [sorted(c for p, c in zip(best.rows()[0].tolist(), best.rows()[2].tolist()) if p == i) for i in range(3)]
    assert got == [sorted(c for _, c in sorted((-s, c) for p, s, c in zip(at, sim, cid) if p == i)[:4]) for i in range(3)]


def test_pool_by_key_has_no_pairs(spark):
    """``knn_pool`` neither joins nor shuffles pairs of queries and vectors, which grow with the square of the table."""
    from glyphmill import queries

    plan = queries.knn_pool(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_stub_model():
    assert dense.fnv1a("hello") == 1335831723
    v = dense.stub_vector("hello", 8)
    assert v[0] == np.float32(0.08559169620275497) and abs(np.linalg.norm(v) - 1) < 1e-6
    assert (dense.stub_vector("", 4) == dense.stub_vector("", 4)).all()


def test_embed_takes_slices(spark):
    """A model gets few texts at a time, whatever the size of the batch, and every row has its own vector."""

    class Few:
        dim = 2

        def encode(self, rows):
            if len(rows) > 512:
                raise ValueError(f"{len(rows)} texts at once")
            return np.array([[len(r), 1] for r in rows], np.float32)

    rows = spark.range(3000).selectExpr("id as chunk_id", "if(id = 5, null, repeat('x', cast(id % 700 as int))) as content").coalesce(1)
    got = {r.chunk_id: r.v for r in dense.embed(rows, Few()).collect()}
    assert got == {i: [0.0 if i == 5 else float(i % 700), 1.0] for i in range(3000)}


def test_related_leaves_the_seed_out(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "chunk_id long, v array<float>")
    got = search.related(v, v.filter("chunk_id = 0").selectExpr("0L as query_id", "chunk_id", "v"), 1).collect()
    assert [r.chunk_id for r in got] == [1]


def test_resolve(spark):
    def at(spans, path, line):
        c = spark.createDataFrame([(i, "f", a, b) for i, (a, b) in enumerate(spans)], "chunk_id long, file_path string, start_line long, end_line long")
        r = lookup.resolve(c, spark.createDataFrame([(0, path, line)], "place_id long, file_path string, line long")).first()
        return r.chunk_id if r else None

    assert at([(1, 10), (5, 20)], "f", 5) == 0
    assert at([(1, 5), (5, 20)], "f", 5) == 1
    assert at([(1, 5)], "f", 5) == 0
    assert at([(1, 5)], "g", 5) is None and at([(1, 5)], "f", 99) is None


def test_chunking():
    assert chunking.pack([(0, 30), (30, 60), (60, 80)], 100) == [(0, 80)]
    assert chunking.pack([(0, 60), (60, 130)], 100) == [(0, 60), (60, 130)]
    assert chunking.pack([(0, 40), (40, 80), (80, 130), (130, 160)], 100) == [(0, 80), (80, 160)]
    N = chunking.Node
    tree = N(0, 300, [N(0, 40), N(40, 80), N(80, 200), N(200, 300)])
    assert chunking.pack(chunking.node_spans(tree, 100), 100) == [(0, 80), (80, 200), (200, 300)]
    assert chunking.node_spans(N(0, 40, [N(0, 10), N(10, 40)]), 5) == [(0, 40)]
    assert [c[2:4] for c in chunking.chunk_source("a\r\nb\r\nc\r\n", "x", None)] == [(1, 3)]
    assert list(chunking.chunk_source(" \n ", "x", None)) == []
    text = "".join("x" * 49 + "\n" for _ in range(60))
    got = list(chunking.chunk_source(text, "x", None))
    assert len(got) >= 2 and all(len(c[0]) <= 750 for c in got) and "".join(c[0] for c in got) == text
    code = "import os\n\n" + "\n\n".join(f"def f{i}(x):\n    '''é'''\n" + "".join(f"    y{j} = x + {j}\n" for j in range(30)) for i in range(4))
    parts = list(chunking.chunk_source(code, "a.py", "python"))
    assert len(parts) >= 4 and any(c[0].startswith("def f2") for c in parts)
    assert all(code.split("\n")[c[2] - 1].strip() in c[0] for c in parts)
    assert list(chunking.chunk_source("def broken(:\n", "a.py", "python"))[0][2:4] == (1, 1)


def test_chunks_hold_every_line_of_python():
    body = lambda n, k: "".join(f"{' ' * n}v{k}_{j} = {j}  # é {j}\n" for j in range(40))
    code = "# Licence\n" + "".join(f"# clause {k} of the licence of this file\n" for k in range(60)) + "\nimport os; import sys;  # both\n\n# before f\n@staticmethod\ndef f(x):\n" + body(4, "f")
    code += "\n\n# before the branch\nif os:\n" + body(4, "a") + "    # within\nelif sys:\n" + body(4, "b") + "else:\n" + body(4, "c")
    code += "try:\n" + body(4, "t") + "except OSError:\n" + body(4, "e") + "else:\n" + body(4, "n") + "finally:\n" + body(4, "z") + "\n# the end\n"
    for text in (code, code.replace("\n", "\r\n"), code.rstrip() + "\n# no line feed"):
        parts = list(chunking.chunk_source(text, "a.py", "python"))
        assert len(parts) > 5 and all(len(c[0]) < 2500 for c in parts)
        assert "".join("".join(c[0] for c in parts).split()) == "".join(text.split())
        lines = text.split("\n")
        for content, _, first, last, _ in parts:
            assert all(x.strip() in lines[first - 1 + k] for k, x in enumerate(content.split("\n"))) and content.count("\n") == last - first


def test_chunk_files(spark):
    f = spark.createDataFrame([("a.txt", "one\ntwo\n", None), ("b.py", None, "python")], "file_path string, text string, language string")
    assert [(r.file_path, r.start_line, r.end_line) for r in chunking.chunk_files(f).collect()] == [("a.txt", 1, 2)]

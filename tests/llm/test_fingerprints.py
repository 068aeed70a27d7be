import os
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import awkward, docs, empty, got, passage

from glyphmill.llm.fingerprints import BAND, BANDS, HASHES, THRESHOLD, band_keys, fingerprints, joined, phrases, prefix_keys, signatures, similar_classes


def parse(symbols):
    """The textbook LZ78 parse: tuples of symbols."""
    known, out, cur = set(), [], ()
    for s in symbols:
        cur += (s,)
        if cur not in known:
            known.add(cur)
            out.append(cur)
            cur = ()
    return out


def brute(rows):
    """(doc_id, class_id, links) of distinct documents, by comparing all signatures."""
    rows = sorted({(i, t or "") for i, t in rows})
    n, sig = signatures(pa.array([t for _, t in rows], pa.string()), HASHES)
    # documents are what differs in id or signature
    own = sorted({(i, joined(s[None])[0].tobytes() if k else b"") for (i, _), k, s in zip(rows, n, sig)})
    flat = [np.frombuffer(s, np.uint32) for _, s in own]
    root, links = list(range(len(own))), [0] * len(own)
    for x, y in combinations(range(len(own)), 2):
        if len(flat[x]) and len(flat[y]) and (flat[x] == flat[y]).mean() >= THRESHOLD:
            links[x] += 1
            links[y] += 1
            a, b = root[x], root[y]
            root = [a if v == b else v for v in root]
    return sorted((own[k][0], min(own[x][0] for x in range(len(own)) if root[x] == root[k]), links[k]) for k in range(len(own)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_parse(symbols):
    # a hash for each phrase of the parse, equal ones only for equal phrases
    want = parse(symbols)
    assert len(phrases(symbols)) == len(want) == len(set(phrases(symbols)))
    assert phrases(symbols)[: len(want) // 2] == phrases([x for p in want[: len(want) // 2] for x in p])


def test_signatures_estimate_the_similarity_of_whole_phrase_sets():
    r = random.Random(4)
    rows = []
    for n in (40, 200, 1500):
        for _ in range(12):
            rows.append(" ".join(r.choice(passage(8, 60).split()) for _ in range(n)))
    sets = [whole(t) for t in rows]
    _, sig = signatures(pa.array(rows), HASHES)
    sig = joined(sig)
    off = [abs((sig[x] == sig[y]).mean() - len(sets[x] & sets[y]) / len(sets[x] | sets[y])) for x, y in combinations(range(len(rows)), 2)]
    assert np.mean(off) < 0.04 and max(off) < 0.17


def test_bands_find_what_is_similar():
    """Signatures that agree in half of their hashes, at random places, share a band."""
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 32, (4000, HASHES), dtype=np.uint32)
    b = r.integers(0, 1 << 32, (4000, HASHES), dtype=np.uint32)
    same = r.permuted(np.arange(HASHES) < HASHES // 2 * np.ones((4000, 1)), axis=1)
    hit = (band_keys(a, BANDS, BAND) == band_keys(np.where(same, a, b), BANDS, BAND)).any(1)
    assert hit.mean() > 0.985
    assert not (band_keys(a, BANDS, BAND) == band_keys(b, BANDS, BAND)).any()


def test_all_that_is_similar_shares_a_key():
    """Signatures that agree in just half of their hashes, wherever these are: none is missed, in any order."""
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 32, (4000, HASHES), dtype=np.uint32)
    b = r.integers(0, 1 << 32, (4000, HASHES), dtype=np.uint32)
    same = r.permuted(np.arange(HASHES) < HASHES // 2 * np.ones((4000, 1)), axis=1)
    same[0] = np.arange(HASHES) % 2 == 0
    b = np.where(same, a, b)
    for order in (np.zeros(1 << 20, np.uint8), r.integers(0, 256, 1 << 20).astype(np.uint8)):
        x, y = (prefix_keys(s, THRESHOLD * HASHES, order) for s in (a, b))
        assert x.shape[1] == HASHES // 2 + 1
        assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist()))
    # two in which no band agrees were never compared
    assert not (band_keys(a[:1], BANDS, BAND) == band_keys(b[:1], BANDS, BAND))[:, : HASHES // BAND].any()


def test_texts_that_share_only_small_phrases_are_unlike(spark):
    rows = ["alpha beta gamma delta to the to the", "one two three to the four to the"]
    assert got(similar_classes(docs(spark, rows))) == [(0, 0, 0), (1, 1, 0)]


def test_classes_match_brute_force(spark):
    base = [passage(k, 400).split() for k in range(4)]
    rows = []
    for k, b in enumerate(base):
        rows.append(" ".join(b))
        rows.append(" ".join(b) + " more words here")
        for step in (60, 25, 12):
            rows.append(" ".join("zzz" if i % step == 5 else w for i, w in enumerate(b)))
    rows += [rows[0], rows[7], "", None, "short text"]
    have = got(similar_classes(docs(spark, rows)))
    assert have == brute(list(enumerate(rows))) and sum(x[2] for x in have) > 40
    assert have == got(similar_classes(docs(spark, rows), tile=3))


def whole(text):
    """The phrases of the whole LZ78 parse, without hashes."""
    return set(parse((text or "").split()))


def test_short_texts_match_whole_phrase_sets(spark):
    r = random.Random(4)
    vocabulary = passage(8, 400).split()
    base = [[r.choice(vocabulary) for _ in range(n)] for n in (30, 50, 80, 120) for _ in range(6)]
    rows = []
    for b in base:
        rows.append(" ".join(b))
        rows.append(" ".join(f"z{i}" if i % 15 == 7 else w for i, w in enumerate(b)))
    # unlike but for one phrase of two words
    rows += [" ".join(["the", *passage(200 + k, 20).split(), "the", "end"]) for k in range(10)]
    s = [whole(t) for t in rows]
    exact = {(x, y): len(s[x] & s[y]) / len(s[x] | s[y]) for x, y in combinations(range(len(rows)), 2)}
    have = {x[0]: x[1] for x in got(similar_classes(docs(spark, rows)))}
    # a signature of 128 hashes is off by 0.15 at most here
    assert all(have[x] == have[y] for (x, y), v in exact.items() if v >= THRESHOLD + 0.15)
    assert all(v < THRESHOLD + 0.15 for (x, y), v in exact.items() if have[x] != have[y])
    assert all(any(exact[min(x, y), max(x, y)] >= THRESHOLD - 0.15 for y in have if y != x and have[y] == have[x]) for x in have if list(have.values()).count(have[x]) > 1)
    assert sum(v >= THRESHOLD + 0.15 for v in exact.values()) >= 20


def test_awkward_rows(spark):
    df = awkward(spark)
    f = fingerprints(df)
    assert f.count() == df.count()
    assert f.filter("doc_id = 3").first().phrases == 0
    assert got(similar_classes(df)) == brute([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None])
    assert similar_classes(empty(spark)).count() == 0


def test_query_against_brute_force(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no data")
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert got(entry.queries()["op2_lz_fingerprints"](spark, sf)) == want

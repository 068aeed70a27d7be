import base64
import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import awkward, docs, empty, got

from glyphmill.llm.token_counts import VOCABULARY, encoder, lengths, pieces, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def enc():
    with open(VOCABULARY, "rb") as f:
        return encoder(f.read())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'sdlrevt é1٣\n\t　.-東京のかкѣ!?qJZ", max_size=120), st.integers(1, 12))
def test_pieces_are_safe(enc, text, most):
    parts = list(pieces(text, most, enc[1]))
    assert "".join(parts) == text and "" not in parts
    assert sum(len(enc[0].encode_ordinary(p)) for p in parts) == len(enc[0].encode_ordinary(text))


def test_long_runs_without_white_space(enc):
    """Ideographs, encoded bytes, letters and packed code are cut too, and their counts stay."""
    r = random.Random(2)
    runs = [
        "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(3000)), base64.b64encode(r.randbytes(6000)).decode(), "x" + "".join(r.choice("0123456789") for _ in range(300)) + ";" + "".join(r.choice("qzJKXVWY") for _ in range(3000)),
        "".join(r.choice("abcxyz(){}[];=+'\"!&|0123") for _ in range(4000)), "".join(r.choice("あいうえおアイウ漢字") for _ in range(3000)), r.randbytes(2000).hex(),
    ]
    for text in runs:
        parts = list(pieces(text, 100, enc[1]))
        assert "".join(parts) == text and max(map(len, parts)) < 400
        assert sum(len(enc[0].encode_ordinary(p)) for p in parts) == len(enc[0].encode_ordinary(text))


def test_groups_are_balanced_by_bytes():
    """A group is what goes to the encoder at once."""
    seen = []

    class Fake:
        def encode_ordinary_batch(self, rows, num_threads):
            seen.append(sum(len(x.encode()) for x in rows))
            return [[0]] * len(rows)

        def encode_ordinary(self, row):
            seen.append(len(row.encode()))
            return [0]

    lengths(Fake(), frozenset(), ["é" * 50 + " ", "a" * 30] * 200, 1 << 16, 1000)
    assert max(seen) <= 1150 and min(seen) >= 850


def test_batches_do_not_matter(enc):
    rows = ["", "a b", "hello world " * 900, "x" * 5000, "<|endoftext|>"]
    want = [len(enc[0].encode_ordinary(r)) for r in rows]
    for piece, batch in ((1 << 16, 1 << 20), (50, 100), (7, 1)):
        assert lengths(*enc, rows, piece, batch).tolist() == want


def test_whole_table(spark, enc):
    df = awkward(spark)
    want = Counter((r.doc_id, len(enc[0].encode_ordinary(r.text or ""))) for r in df.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts(df).collect()) == want
    assert token_counts(empty(spark)).count() == 0


def test_query_against_whole_encoding(spark, enc):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no data")
    want = sorted((r.doc_id, len(enc[0].encode_ordinary(r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert got(entry.queries()["op1_token_counts"](spark, sf)) == want


def test_special_strings_are_text(spark):
    assert got(token_counts(docs(spark, ["<|endoftext|>", None])))[0][1] > 1

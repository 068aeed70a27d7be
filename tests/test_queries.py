"""Every query against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from glyphmill import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def rows(data, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return Counter(tuple(tuple(r[i]) if isinstance(r[i], list) else r[i] for i in order) for r in data)


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, DATA)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in core.SQL:
        want = con.sql(core.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

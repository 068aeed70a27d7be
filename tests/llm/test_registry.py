"""The operators' queries against their SQL on the smallest tables."""

import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    n = sorted(int(m[1]) for m in (re.match(r"op(\d+)_", q) for q in entry.queries()) if m)
    assert n == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(q for q in entry.oracle_sql() if q.startswith("op")))
def test_query(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no data")
    con = duckdb.connect()
    path = f"{SF}/documents.parquet"
    con.sql(f"create view documents as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(tuple(r) for r in df.select(*want.columns).collect()) == Counter(want.fetchall())

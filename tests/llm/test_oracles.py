"""The operators that have SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from quireflow.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    got = sorted(repr([r[n] for n in names]) for r in df.collect())
    assert got == sorted(repr([r[i] for i in order]) for r in want.fetchall())

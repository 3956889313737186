"""The contract queries with a SQL twin against DuckDB, at the smallest scale."""

import os

import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    out = con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(out.columns)
    key = lambda row: str(tuple(round(x, 9) if isinstance(x, float) else x for x in row))
    want = sorted(key(dict(zip(out.columns, r, strict=True))[c] for c in columns) for r in out.fetchall())
    assert sorted(key(r[c] for c in columns) for r in df.collect()) == want

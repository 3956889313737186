"""Every query with a SQL twin against DuckDB, at the smallest scale."""

import os

import pytest

from tessera.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    out = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(out.columns)
    columns = sorted(df.columns)
    want = sorted(tuple(plain(dict(zip(out.columns, r, strict=True))[c]) for c in columns) for r in out.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == want

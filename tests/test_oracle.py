"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from eventide.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return repr(round(float(value), 9) + 0.0)
    return repr(float(value)) if isinstance(value, int) and abs(value) < 2**53 else str(value)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.collect()
    assert len(set(columns)) == len(columns)
    if name not in catalogue.ORACLE_SQL:
        return
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted("|".join(plain(r[c]) for c in columns) for r in rows) == sorted("|".join(plain(r[i]) for i in at) for r in want.fetchall())

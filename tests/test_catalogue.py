"""Every query of the catalogue on the smallest tables, against DuckDB where it has an SQL text."""

import datetime as dt
import glob
import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.6g}" if v == v else "NULL"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return "NULL" if v is None else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    text = entry.oracle_sql().get(name)
    if text is None:
        return
    rel = duck.sql(text)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(got) == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def test_names_and_oracles_fit():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry is not None

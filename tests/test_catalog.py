"""Every query with SQL gives the rows that DuckDB gives."""

import datetime

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return repr(round(v, 9))
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


def rows(columns, got):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in at) for r in got)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(__spark_entry__.oracle_sql()[name]), __spark_entry__.queries()[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

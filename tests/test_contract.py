"""The driver's contract: each query's rows against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def engine_queries():
    from trendloom.plans import catalogue

    return sorted(catalogue.ORACLES)


@pytest.mark.parametrize("name", engine_queries())
def test_rows_equal_the_sql_s(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = sorted(rel.select(", ".join(f'"{c}"' for c in cols)).fetchall(), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert tuple(a) == tuple(b)

"""Every query with SQL against DuckDB on the smallest tables, the others for rows and a schema that repeats."""

import glob
import os

import pytest
from conftest import DATA

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
SLOW = {"p2_recall"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{round(v, 6) + 0.0:.6f}"
        return f"{float(v):.6f}" if type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    assert QUERIES


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    answer = db.execute(ORACLE[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    want, got = plain(answer.fetchall(), columns), plain([tuple(r) for r in df.collect()], df.columns)
    assert len(want) == len(got)
    assert all(a == b or all(x == y or abs(float(x) - float(y)) < 1e-4 for x, y in zip(a, b, strict=True)) for a, b in zip(want, got, strict=True))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns))
    df.collect()

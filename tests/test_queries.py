"""Every query with SQL against DuckDB on the smallest tables, and the driver's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stackloom.plans import analysis_sql, problem_sql, profile_sql

DATA = "/root/testdata/sf0.001"
SQL = {**profile_sql.SQL, **analysis_sql.SQL, **problem_sql.SQL}
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    rows = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_no_query_is_empty_on_both_sides(duck):
    for name, sql in SQL.items():
        assert duck.sql(sql).limit(1).fetchall(), name


def test_contract(spark):
    assert set(SQL) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_the_core_stands_without_the_subpackage():
    import re

    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/stackloom/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert not re.search(r"stackloom\.llm|from \.+llm", open(path).read()), path

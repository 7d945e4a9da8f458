"""Every registered query against its SQL, run by DuckDB over the same tables."""

import os

import duckdb
import pytest

from corvane.registry import FLAGSHIP, ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def canonical(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "isoformat"):
        return str(value).replace("+00:00", "")
    if isinstance(value, (list, tuple)):
        return [canonical(x) for x in value]
    return value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(([canonical(r[c]) for c in columns] for r in df.collect()), key=repr)
    assert got == sorted(([canonical(r[i]) for i in at] for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLE

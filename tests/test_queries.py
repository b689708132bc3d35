"""Each query with SQL on the smallest tables, against DuckDB."""

import duckdb
import pytest

from sketchloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    assert rows_of(registry.QUERIES[name](spark, sf).toPandas()) == rows_of(duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["contig", "bin", "h", "n"]

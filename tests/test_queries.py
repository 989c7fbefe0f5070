"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def bag(table):
    names = sorted(table.column_names)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return names, sorted((tuple(map(plain, r)) for r in zip(*[table.column(n).to_pylist() for n in names], strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert bag(entry.queries()[name](spark, sf).toArrow()) == bag(duck.sql(entry.oracle_sql()[name]).to_arrow_table())


def test_entry(spark):
    assert entry.entry(spark).columns == ["qry", "rank", "ref", "xny", "metric", "distance"]


def test_every_query_without_sql_is_known():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert all(k == "pipeline" or k.startswith("op") for k in without)

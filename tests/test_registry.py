"""Every registered query against its SQL, and what all queries must have in common."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry_module
from lorekeep.registry.oracle import ORACLE
from lorekeep.registry.queries import QUERIES
from lorekeep.sources.driver_tables import SCHEMAS


@pytest.fixture(scope="module")
def sf_dir():
    """Larger than elsewhere: the smallest tables hold too few rows for repeated requests and the like."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return value.isoformat() if isinstance(value, dt.datetime) else repr(value)


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, database, name):
    df = QUERIES[name](spark, sf_dir)
    result = database.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    got = comparable(df.columns, df.collect())
    assert got and got == comparable(columns, result.fetchall())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["owner", "total_items", "missing_tags", "missing_description", "stale"]
    assert df.count() == 20

"""Every registered query against its SQL, run by DuckDB on the same tables."""

import math

import duckdb
import pandas as pd
import pytest
from support import SF

import __spark_entry__ as contract
from skyledger.queries import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return repr(float(value))


def _rows(frame):
    ordered = frame[sorted(frame.columns)]
    return sorted((tuple(map(_plain, r)) for r in ordered.values.tolist()), key=str)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(registry()) - set(ORACLES) == {"propagate_catalogue_sgp4", "find_passes_sgp4"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 10

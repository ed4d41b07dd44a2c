"""Every query that has SQL gives what DuckDB gives on the smallest data; the others give rows."""

import importlib
import math
import pkgutil

import duckdb
import pandas as pd
import pytest

import tickloom.plans
from tickloom.plans.base import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

for _module in pkgutil.iter_modules(tickloom.plans.__path__):
    importlib.import_module(f"tickloom.plans.{_module.name}")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return connection


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(([plain(v) for v in row] for row in frame.itertuples(index=False)), key=lambda row: [str(v) for v in row])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0

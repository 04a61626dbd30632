"""Every core query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from waymark.plans import catalogue


@pytest.fixture(scope="session")
def database(small):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, database, name):
    df = catalogue.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalogue.ORACLES:
        result = database.sql(catalogue.ORACLES[name])
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=repr)


def test_every_oracle_has_its_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert catalogue.FLAGSHIP in catalogue.QUERIES

"""Every registered query against its SQL in DuckDB, value by value."""

import datetime
import math

import duckdb
import pytest
from conftest import DATA

from quillstone.queries import ORACLES, QUERIES
from quillstone.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck():
    held = duckdb.connect()
    for t in TABLES:
        held.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return held


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    if name in ORACLES:
        other = duck.sql(ORACLES[name])
        at = [other.columns.index(c) for c in columns]
        assert sorted(other.columns) == columns
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in other.fetchall())
    else:
        assert rows

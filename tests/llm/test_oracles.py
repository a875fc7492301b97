"""The queries that SQL can express against DuckDB, value by value."""

import duckdb
import pytest
from conftest import DATA

from quillstone.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", [DATA, DATA.replace("sf0.001", "sf0.01")])
def test_oracle(spark, name, sf):
    held = duckdb.connect()
    held.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    other = held.sql(ORACLES[name])
    columns = sorted(other.columns)
    found = QUERIES[name](spark, sf)
    assert sorted(found.columns) == columns
    rows = [tuple(map(repr, r)) for r in found.select(*columns).collect()]
    assert sorted(rows) == sorted(tuple(map(repr, (r[other.columns.index(c)] for c in columns))) for r in other.fetchall())

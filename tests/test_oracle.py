"""Every registered query beside its SQL twin."""

import duckdb
import pytest
from tests.paths import SF

from pixelquilt.catalog import QUERIES, SQL
from tools.compare import TABLES, compare


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return found


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    line = compare(spark, connection, name, QUERIES[name], SQL[name], SF)
    assert line.startswith("ok"), line


def test_entry(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark)
    assert rows.count() > 0
    assert {"input_ids", "attention_mask", "labels"} <= set(rows.columns)

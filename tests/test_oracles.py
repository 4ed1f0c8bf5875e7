"""Every registered query with SQL against DuckDB."""

import pytest

from postmill import registry
from tests.oracle import SF, connect, oracle_rows, rows_of


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_matches_oracle(spark, con, name):
    columns, rows = rows_of(registry.QUERIES[name](spark, SF))
    other_columns, other_rows = oracle_rows(con, registry.ORACLES[name])
    assert columns == other_columns
    assert rows == other_rows


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query against DuckDB on the same parquet files."""

import pytest
from conftest import SF_DIR
from oracle_compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from ridelake.registry import all_queries

REGISTERED = all_queries()
QUERIES = {name: run for name, run in queries().items() if name in REGISTERED}
ORACLE = {name: sql for name, sql in oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_checking_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_runs(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) == []

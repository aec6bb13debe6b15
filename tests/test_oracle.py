"""Every registered query against its check SQL on the driver's small tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck
from conftest import SF_DIR

# Queries of the separate corpus subpackage have tests of their own.
QUERIES = {k: v for k, v in entry.queries().items() if k not in entry.CORPUS}
SQLS = {k: v for k, v in entry.oracle_sql().items() if k not in entry.CORPUS}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_check_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, QUERIES[name], SQLS.get(name))
    assert ok, note


def test_every_query_has_check_sql():
    assert set(SQLS) == set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

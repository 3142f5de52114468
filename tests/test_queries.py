"""Every registered query against its SQL twin on the same Parquet files."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from recloom.queries import registry
from tests.conftest import SF_DIR

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def duck():
    registry.SHARED = {}
    yield connect(SF_DIR)
    registry.SHARED = None


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    rows = entry.queries()[name](spark, SF_DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
    else:
        assert compare(rows, duck.execute(sql).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

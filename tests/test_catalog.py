"""Every query against its SQL on the smallest tables, and the driver contract."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from tracewright import catalog

NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) == ""


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(NAMES)
    assert set(NAMES) <= set(entry.queries())


def test_entry_gives_three_variants(spark):
    assert entry.entry(spark).count() == 3

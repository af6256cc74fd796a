"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from catalog.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    problem, _ = compare(spark, duck, name, SF_SMALL)
    assert not problem


def test_entry(spark):
    assert driver.entry(spark).count() > 0

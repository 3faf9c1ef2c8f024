"""Every registered query next to its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_equals_twin(spark, con, name):
    ok, text = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, text


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query against its SQL. Those without SQL are in test_restated.py and test_grounding.py."""

import os

import pytest

from corpuscle import catalogue

from .oracle import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    compare(catalogue.queries()[name](spark, SF), SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

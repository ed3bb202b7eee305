"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_sql(spark, con, name):
    equal, remark = check.compare(spark, con, SF, name)
    assert equal is not False, remark


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0

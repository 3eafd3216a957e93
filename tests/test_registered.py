import pytest

import __spark_entry__ as driver
from termspire import registered
from comparison import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["qno", "docid", "bm25score", "name", "rank"]
    assert result.count() == 60


def test_every_query_has_an_oracle():
    assert set(registered.queries()) - set(registered.oracle_sql()) == set()
    assert set(registered.oracle_sql()) <= set(registered.queries())
    assert set(registered.queries()) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_agrees_with_its_sql(spark, duck, name):
    got = registered.queries()[name](spark, SF_DIR).toArrow()
    expected = duck.sql(registered.oracle_sql()[name]).to_arrow_table()
    assert differences(got, expected) is None

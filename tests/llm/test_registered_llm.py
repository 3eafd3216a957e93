import sys

import pytest

import __spark_entry__ as driver
from comparison import connect, differences
from termspire.llm import registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_all_are_offered():
    names = set(registered.queries()) | {"pipeline"}
    assert names <= set(driver.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_agrees_with_its_sql(spark, duck, name):
    got = registered.queries()[name](spark, SF).toArrow()
    assert differences(got, duck.sql(registered.oracle_sql()[name]).to_arrow_table()) is None


def test_the_rest_does_without(monkeypatch):
    def absent(name, *rest):
        return None if name in ("termspire.llm", "corpus_pipeline") else find(name, *rest)

    find = driver.find_spec
    monkeypatch.setattr(driver, "find_spec", absent)
    assert not any(n.startswith("op") or n == "pipeline" for n in [*driver.queries(), *driver.oracle_sql()])
    assert "bm25_top20" in driver.queries() and "termspire" in sys.modules

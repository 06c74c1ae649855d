"""The driver contract: entry(), queries() and oracle_sql() agree with DuckDB."""

import pytest

import __spark_entry__ as e
from conftest import SF001
from oracle_compare import compare, duck


def test_entry_runs(spark):
    df = e.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 60


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    info = compare(spark, name, e.queries()[name], e.oracle_sql()[name], SF001, con)
    assert info["ok"], info.get("why")

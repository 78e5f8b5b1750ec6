"""Every registered telemetry query against its SQL oracle in DuckDB (sf0.001)."""

import pytest
from helpers import SF001, assert_equals_sql, duck

import __spark_entry__ as E
from frostline.plans.catalog import QUERIES
from frostline.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF001, "events")


def test_every_query_has_oracle_or_reason():
    assert set(ORACLE) <= set(E.oracle_sql()) and set(QUERIES) <= set(ORACLE)
    missing = set(E.queries()) - set(E.oracle_sql())
    assert missing == set(E.NO_ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert_equals_sql(QUERIES[name](spark, SF001), con, ORACLE[name])


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.count() == 15
    assert "hours_below_20mK_current" in out.columns

"""The training-data queries that have SQL, against DuckDB (sf0.001)."""

import pytest
from helpers import SF001, assert_equals_sql, duck

from frostline.llm.oracle import NO_ORACLE, ORACLE
from frostline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF001, "pages", "conversations", "documents", "embeddings")


def test_sql_or_reason():
    assert set(QUERIES) | {"pipeline"} == set(ORACLE) | set(NO_ORACLE)
    assert not set(ORACLE) & set(NO_ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert_equals_sql(QUERIES[name](spark, SF001), con, ORACLE[name])

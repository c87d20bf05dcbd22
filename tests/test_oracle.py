"""Spark vs DuckDB oracle for every SQL-expressible query (sf0.001)."""

import pytest

from check_oracle import compare, duck
from tests.conftest import SF_SMALL
from tranche.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("qid", [q for q, v in QUERIES.items() if v.sql is not None])
def test_oracle(spark, con, qid):
    ok, msg, _, _ = compare(spark, con, SF_SMALL, qid)
    assert ok, msg

"""Every registered query against its SQL."""

import os

import pytest

from oracle import connect, difference
from sparkweft.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, SF_DIR), connection, ORACLES[name]) is None


def test_kmeans_properties(spark):
    rows = QUERIES["kmeans_groups"](spark, SF_DIR).collect()
    assert len({row["vec_id"] for row in rows}) == len(rows) == 500
    assert {row["cluster_id"] for row in rows} <= set(range(10))

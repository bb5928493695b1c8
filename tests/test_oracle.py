"""Every registered query against its SQL. ``ORACLE_SF_DIR`` chooses the tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference
from workload.oracles import ORACLES
from workload.queries import REGISTRY

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLES) == set(REGISTRY)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_matches_sql(spark, connection, name):
    assert difference(queries()[name](spark, FOLDER), connection, oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0

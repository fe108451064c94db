"""Queries against their SQL counterparts on the smallest tables."""

import os

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from studyflow.catalog import QUERIES as CATALOG

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The corpus operators have tests of their own.
QUERIES, SQL = ({n: q for n, q in x.items() if n in CATALOG} for x in (entry.queries(), entry.oracle_sql()))
# The streams have tests of their own.
NAMES = [n for n in QUERIES if not n.startswith("stream_") and n != "trigger_if_data"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no star-schema tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, text = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "planned_week" in df.columns

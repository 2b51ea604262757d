"""Every query of the library against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from oracle import compare, connect
from tieout.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TIEOUT_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    ok, note, _ = compare(spark, duck, FOLDER, name, QUERIES, ORACLES)
    assert ok, note

"""Every registered query at the smallest scale: equal to its SQL, or non-empty."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import DATA, compare, duck

SF = f"{DATA}/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, note, _ = compare(name, QUERIES[name], ORACLES.get(name), spark, SF, con)
    assert status in ("ok", "near", "rows"), note


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every query with an SQL check, against DuckDB on the same tables."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as driver

ORACLES = driver.oracle_sql()
QUERIES = driver.queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    assert compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    # Queries of the training-data subpackage are tested in its own folder.
    own = {n for n in QUERIES if n == "pipeline" or n.startswith("op")}
    assert set(QUERIES) - set(ORACLES) - own == {"d7_bcpnn_mc", "d8a_gps_fit"}


def test_entry(spark):
    assert os.path.isdir(driver.SMOKE_DIR)
    assert driver.entry(spark).count() == 25

"""Every registered query with an oracle against DuckDB over the same Parquet files."""

import os

import pytest

import __spark_entry__ as entry
from compare import difference, duck, spark_frame

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# WATTLINE_ALL=1 runs every oracle; the default takes every fourth one, tools/compare.py all of them at sf0.01.
NAMES = sorted(ORACLES) if os.environ.get("WATTLINE_ALL") else sorted(ORACLES)[::4]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got = spark_frame(QUERIES[name](spark, SF))
    assert difference(got, con.execute(ORACLES[name]).df()) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

"""Every query with SQL gives the same rows and types as the SQL."""

import warnings

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck
from flockframe.plans import catalogue

# minutes of small rounds on the sparse test tables; covered by test_neighbours.py
SLOW = {"link_components"}
QUERIES, ORACLES = ({k: v for k, v in found.items() if k in catalogue.QUERIES} for found in (entry.queries(), entry.oracle_sql()))


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf, con, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        n, note = compare(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
    assert not note, note
    assert n > 0 or name in ORACLES


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "trend" in df.columns

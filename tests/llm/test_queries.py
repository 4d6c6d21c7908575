import re
import warnings

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck
from flockframe.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = [re.match(r"op([0-9]+)_", n)[1] for n in queries.QUERIES]
    assert sorted(map(int, names)) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_as_its_sql(spark, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        n, note = compare(spark, duck(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name])
    assert not note, note
    assert n > 0

"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from tools.check_oracles import compare

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


def test_only_known_oracles():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf, name):
    good, note, _ = compare(spark, sf, name, QUERIES[name], ORACLES.get(name))
    assert good, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0

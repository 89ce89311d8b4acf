"""Every registered query against its SQL, value by value."""

import pytest
from oracle import compare

from deckloom.plans import ORACLES, QUERIES


def test_every_query_has_its_sql():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], sf) == ""


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

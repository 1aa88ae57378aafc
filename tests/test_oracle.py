"""Every query agrees with its SQL on the small tables."""

import pytest

from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    rows = QUERIES[name](spark, SF).toPandas()
    assert difference(rows, connect(SF).execute(ORACLES[name]).df()) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert e.oracle_sql().keys() <= e.queries().keys()
    assert QUERIES.keys() <= e.queries().keys() and ORACLES.keys() <= e.oracle_sql().keys()

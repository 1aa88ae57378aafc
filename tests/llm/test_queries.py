"""The queries that SQL can express agree with it on the small tables."""

import pytest

from checks.compare import connect, difference
from citeflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    rows = QUERIES[name](spark, SF).toPandas()
    assert difference(rows, connect(SF).execute(ORACLES[name]).df()) is None

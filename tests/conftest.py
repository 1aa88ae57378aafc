import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from citeflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture
def values(spark):
    """One expression evaluated over a list of single values, in order."""
    from pyspark.sql import functions as F

    def run(make, items, kind="string"):
        df = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}")
        return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]

    return run

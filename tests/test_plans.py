"""Physical plans and source rules."""

import pathlib

import pytest

from checks.queries import QUERIES
from citeflow.operators import ranking

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parent.parent


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_udf(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_topk_limits_before_the_shuffle(spark):
    scores = spark.range(10).selectExpr("id % 2 as query_id", "id as cand_id", "id * 0.1d as score")
    assert plan(ranking.topk_per_group(scores, 2)).count("WindowGroupLimit") == 2


def test_scan_reads_only_what_is_needed(spark):
    text = plan(QUERIES["sample_per_group"](spark, SF))
    assert "l_extendedprice" not in text


def test_source_rules():
    for path in list((ROOT / "citeflow").rglob("*.py")) + list((ROOT / "checks").rglob("*.py")):
        text = path.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text, path
        assert ".rdd." not in text.replace(".rdd.getNumPartitions", ""), path

"""Splits that survive new rows."""

import pytest
from pyspark.sql import functions as F

from citeflow.operators import ledger
from citeflow.params import SplitRatios


def rows(spark, ids, strata=3):
    return spark.createDataFrame([(i, f"s{i % strata}") for i in ids], "row_id int, stratum string")


@pytest.mark.parametrize("hot_rows", [250_000, 7])
@pytest.mark.parametrize("ratios", [SplitRatios(), SplitRatios(0.7, 0.2, 0.1)])
def test_old_rows_stay_and_quotas_are_exact(spark, tmp_path, hot_rows, ratios):
    path, seen = str(tmp_path / "ledger"), {}
    for batch, upto in enumerate((40, 41, 90, 200)):
        got = ledger.extend_ledger(rows(spark, range(upto)), path, batch, "stratum", ratios, hot_rows=hot_rows).collect()
        now = {r.row_id: r.split for r in got}
        assert len(now) == len(got) == upto and seen.items() <= now.items()
        seen = now
        sizes = ledger.read_ledger(spark, path).groupBy("stratum").agg(
            F.count("*").alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "valid", "test")]
        )
        for r in sizes.select("*", ledger.quotas(F.col("n"), F.col("stratum"), ratios).alias("q")).collect():
            assert (r.train, r.valid, r.test) == (r.q.train, r.q.valid, r.q.test)
            assert abs(r.train - r.n * ratios.train) < 1 and abs(r.valid + r.test - r.n * (1 - ratios.train)) < 1


def test_a_batch_run_again_writes_the_same_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.extend_ledger(rows(spark, range(30)), path, 0, "stratum")
    first = sorted(ledger.extend_ledger(rows(spark, range(20, 60)), path, 1, "stratum").collect())
    ledger.extend_ledger(rows(spark, range(90)), path, 2, "stratum")
    assert sorted(ledger.extend_ledger(rows(spark, range(20, 60)), path, 1, "stratum").collect()) == first
    assert ledger.read_ledger(spark, path).count() == 90


def test_nulls_repeats_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.read_ledger(spark, path).count() == 0
    assert ledger.extend_ledger(rows(spark, []), path, 0, "stratum").count() == 0
    odd = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, None), (None, "a")], "row_id int, stratum string")
    got = {r.row_id: r for r in ledger.extend_ledger(odd, path, 1, "stratum").collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].stratum == "a" and {got["2"].number, got["3"].number} == {1, 2}
    again = ledger.extend_ledger(odd.limit(1), path, 2, "stratum")
    assert again.count() == 3
    split = ledger.with_split(odd.withColumn("split", F.lit("x")), again).collect()
    assert len(split) == 5 and {r.split for r in split if r.row_id is None} == {None}


def test_many_small_strata_come_near_the_shares(spark, tmp_path):
    got = ledger.extend_ledger(rows(spark, range(6000), 3000), str(tmp_path / "l"), 0, "stratum")
    counts = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert abs(counts["train"] - 4800) < 120 and abs(counts["valid"] - 600) < 120 and abs(counts["test"] - 600) < 120

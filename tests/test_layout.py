"""Tables laid out by key: joins without a shuffle."""

import pytest
from pyspark.sql import functions as F

from citeflow.sources.layout import join_laid_out, open_laid_out, write_laid_out


@pytest.fixture
def sides(spark):
    left = spark.range(400).select(
        "id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k")
    )
    right = spark.createDataFrame([("hot", 1, [1]), ("k1", 2, [2]), ("k2", 3, None), ("none", 4, []), (None, 5, [])], "k string, `a b` int, v array<int>")
    return left, right


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [250_000, 20, 5])
def test_equals_the_plain_join(spark, tmp_path, sides, how, hot_rows):
    left, right = sides
    a = write_laid_out(left, str(tmp_path / "a"), "k", 4, hot_rows=hot_rows)
    b = write_laid_out(right, str(tmp_path / "b"), "k", 4, unique=True, hot_rows=hot_rows)
    assert (a.hot_rows is None) == (hot_rows > 400)
    assert sorted(map(str, a.all_rows().collect())) == sorted(map(str, left.collect()))
    got, wanted = join_laid_out(a, b, how), left.join(right, "k", how)
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, wanted.select(sorted(wanted.columns)).collect()))
    again = join_laid_out(open_laid_out(spark, str(tmp_path / "a")), open_laid_out(spark, str(tmp_path / "b")), how)
    assert again.count() == wanted.count()


def test_no_exchange(spark, tmp_path, sides, no_broadcast):
    left, right = sides
    b = write_laid_out(right, str(tmp_path / "b"), "k", 4, unique=True)
    cold = join_laid_out(write_laid_out(left, str(tmp_path / "a"), "k", 4), b)
    text = cold._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert text.count("Scan parquet") == 2
    hot = join_laid_out(write_laid_out(left, str(tmp_path / "h"), "k", 4, hot_rows=20), b)
    assert "Exchange hashpartitioning" not in hot._jdf.queryExecution().executedPlan().toString()


def test_large_rows_for_hot_keys_are_not_broadcast(spark, tmp_path, sides, monkeypatch):
    left, right = sides
    monkeypatch.setattr("citeflow.sources.layout.BROADCAST_BYTES", 1)
    a = write_laid_out(left, str(tmp_path / "a"), "k", 4, hot_rows=20)
    b = write_laid_out(right, str(tmp_path / "b"), "k", 4, unique=True)
    assert join_laid_out(a, b).count() == 400 and join_laid_out(a, b, "inner").count() == left.join(right, "k").count()


def test_refusals_and_empty_tables(spark, tmp_path, sides):
    left, right = sides
    with pytest.raises(ValueError, match="more than once"):
        write_laid_out(left, str(tmp_path / "x"), "k", 4, unique=True)
    a = write_laid_out(left.limit(0), str(tmp_path / "a"), "k", 4)
    b = write_laid_out(right, str(tmp_path / "b"), "k", 4, unique=True)
    assert join_laid_out(a, b).count() == 0
    with pytest.raises(ValueError, match="equally many buckets"):
        join_laid_out(a, write_laid_out(right, str(tmp_path / "c"), "k", 5, unique=True))
    with pytest.raises(ValueError, match="is not made"):
        join_laid_out(a, b, "full")

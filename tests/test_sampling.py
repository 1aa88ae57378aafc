import hashlib

import pytest
from pyspark.sql import functions as F

from citeflow.operators import sampling
from citeflow.operators.numbering import number_all, number_by_value, number_in_group
from citeflow.operators.selection import first_by_hash, first_by_value


def digest(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def groups(spark):
    """Groups of 1 to 15 rows, one of 300, and rows without a group."""
    rows = [(f"g{n}", f"g{n}-{i}") for n in range(1, 16) for i in range(n)]
    rows += [("hot", f"hot-{i}") for i in range(300)] + [(None, f"none-{i}") for i in range(5)]
    return spark.createDataFrame(rows, "passage_id string, row_id string").cache()


def brute_sample(rows, fraction, seed, least=0):
    by = {}
    for r in rows:
        if r.passage_id is not None:
            by.setdefault(r.passage_id, []).append(r.row_id)
    kept = set()
    for ids in by.values():
        ids.sort(key=lambda k: (digest(seed, k), k))
        kept |= set(ids[: max(round(fraction * len(ids)), least)])
    return kept


@pytest.mark.parametrize("fraction", [0.2, 0.25, 0.07, 1.0])
@pytest.mark.parametrize("hot_rows", [20, 1000])
def test_sample_per_group(groups, fraction, hot_rows):
    got = {r.row_id for r in sampling.sample_per_group(groups, "passage_id", fraction, 7, hot_rows=hot_rows).collect()}
    assert got == brute_sample(groups.collect(), fraction, 7)


def test_every_group_survives_when_asked(groups):
    got = sampling.sample_per_group(groups, "passage_id", 0.01, 7, min_per_group=1)
    assert got.select("passage_id").distinct().count() == 16


def test_sample_does_not_depend_on_partitioning(groups):
    one = sampling.sample_per_group(groups.repartition(1), "passage_id", 0.5, 7)
    many = sampling.sample_per_group(groups.repartition(7), "passage_id", 0.5, 7)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_slices_give_the_same_numbers(groups):
    plain = number_in_group(groups, ["passage_id"], 1, size="size")
    sliced = number_in_group(groups, ["passage_id"], 1, size="size", hot_rows=3)
    assert plain.exceptAll(sliced).isEmpty() and sliced.exceptAll(plain).isEmpty()


def test_number_all(groups):
    order = sorted((r.row_id for r in groups.collect()), key=lambda k: (digest(3, k), k))
    for hot_rows in (10, 10_000):
        got = number_all(groups, 3, hot_rows=hot_rows).orderBy("number").collect()
        assert [r.row_id for r in got] == order
        assert [r.number for r in got] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_number_by_value(groups, hot_rows):
    got = number_by_value(groups, F.col("row_id"), hot_rows=hot_rows).orderBy("number").collect()
    assert [r.row_id for r in got] == sorted(r.row_id for r in groups.collect())
    assert [r.number for r in got] == list(range(1, len(got) + 1))


@pytest.mark.parametrize("small", [10_000, 3])
def test_sample_n(groups, small):
    order = sorted((r.row_id for r in groups.collect()), key=lambda k: (digest(3, k), k))
    for n in (0, 1, 50, len(order) - 1, len(order), 10**6):
        got = first_by_hash(groups, n, 3, small=small).collect()
        assert len(got) == min(n, len(order)) and {r.row_id for r in got} == set(order[:n])
    with pytest.raises(ValueError, match="not unique"):
        first_by_hash(groups.select(F.lit("same").alias("row_id")), 50, 3, small=3)


@pytest.mark.parametrize("small", [10_000, 3])
def test_first_n(spark, groups, small):
    wanted = sorted(r.row_id for r in groups.collect())
    for n in (0, 1, 40, len(wanted) - 1, 10**6):
        got = first_by_value(groups, n, "row_id", small=small).collect()
        assert sorted(r.row_id for r in got) == wanted[:n]
    odd = spark.range(2000).select(F.when(F.col("id") > 0, F.timestamp_micros(F.col("id") * 7919 % 2000)).alias("t"))
    got = sorted((r.t is not None, r.t) for r in first_by_value(odd, 700, "t", small=small).collect())
    assert got == sorted((r.t is not None, r.t) for r in odd.collect())[:700]
    with pytest.raises(ValueError, match="not unique"):
        first_by_value(spark.range(500).select(F.lit(1).alias("t")), 50, "t", small=3)


def test_selection_shuffles_the_last_range_only(groups):
    """What comes back is a filter on the table."""
    for selected in (first_by_hash(groups, 100, 3, small=3), first_by_value(groups, 100, "row_id", small=3)):
        plan = selected._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_shuffle_rows(groups):
    got = [r.row_id for r in sampling.shuffle_rows(groups, 3).collect()]
    assert got == sorted(got, key=lambda k: (digest(3, k), k))


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_batches_have_distinct_keys(groups, hot_rows):
    rows = groups.where("passage_id is not null")
    got = sampling.assign_batches(rows, "passage_id", 4, 1, hot_rows=hot_rows)
    assert got.count() == rows.count()
    sizes = got.groupBy("occurrence", "batch").agg(F.count("*").alias("n"), F.countDistinct("passage_id").alias("d")).collect()
    assert all(r.n == r.d <= 4 for r in sizes)

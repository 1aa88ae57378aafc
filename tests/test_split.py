import hashlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from citeflow.operators.splitting import stratified_split
from citeflow.params import SplitRatios


def digest(key, seed=42):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


def allot(sizes, take):
    """Largest remainders, by hand."""
    total = sum(sizes.values())
    part = {s: take * n // total for s, n in sizes.items()}
    order = sorted(sizes, key=lambda s: (-(take * sizes[s] % total), digest(s), s))
    for s in order[: take - sum(part.values())]:
        part[s] += 1
    return part


def brute(rows, ratios):
    sizes = {}
    for stratum, _ in rows:
        sizes[stratum] = sizes.get(stratum, 0) + 1
    sizes = {s: n for s, n in sizes.items() if n >= 2}
    rest_share = Fraction(str(ratios.valid)) + Fraction(str(ratios.test))
    n = sum(sizes.values())
    n_rest = -(-n * rest_share.numerator // rest_share.denominator)
    train = allot(sizes, n - n_rest)
    rest = {s: sizes[s] - train[s] for s in sizes}
    share = Fraction(str(ratios.test)) / rest_share
    test = allot(rest, -(-n_rest * share.numerator // share.denominator))
    out = {}
    for stratum in {s for s, _ in rows}:
        ids = sorted((i for s, i in rows if s == stratum), key=lambda k: (digest(k), k))
        for at, i in enumerate(ids):
            if stratum not in sizes or at < train[stratum]:
                out[i] = "train"
            else:
                out[i] = "valid" if at < sizes[stratum] - test[stratum] else "test"
    return out


ROWS = [(f"s{n}", f"s{n}-{i}") for n in range(1, 31) for i in range(1 + n % 11)] + [("big", f"b-{i}") for i in range(400)]
RATIOS = [SplitRatios(), SplitRatios(0.9, 0.05, 0.05), SplitRatios(0.7, 0.1, 0.2)]


@pytest.mark.parametrize("ratios", RATIOS)
@pytest.mark.parametrize("hot_rows", [7, 100_000])
def test_split_by_hand(spark, ratios, hot_rows):
    df = spark.createDataFrame(ROWS, "stratum string, row_id string")
    got = stratified_split(df, "stratum", ratios, strict=False, hot_rows=hot_rows).collect()
    assert len(got) == len(ROWS)
    assert {r.row_id: r.split for r in got} == brute(ROWS, ratios)


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame(ROWS, "stratum string, row_id string")
    a = stratified_split(df.repartition(1), "stratum", strict=False)
    b = stratified_split(df.repartition(5), "stratum", strict=False)
    assert a.exceptAll(b).isEmpty()


def test_strict_refuses_small_strata(spark):
    df = spark.createDataFrame(ROWS, "stratum string, row_id string")
    with pytest.raises(ValueError, match="fewer than two"):
        stratified_split(df, "stratum")
    many = spark.range(100).select(F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias("stratum"), F.col("id").alias("row_id"))
    with pytest.raises(ValueError):
        stratified_split(many, "stratum")
    even = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 4).alias("stratum"), F.col("id").alias("row_id"))
    assert stratified_split(even, "stratum").where("split = 'train'").count() == 320


def test_wide_arithmetic_gives_the_same(spark, monkeypatch):
    import citeflow.operators.splitting as s

    df = spark.createDataFrame(ROWS, "stratum string, row_id string")
    narrow = stratified_split(df, "stratum", strict=False)
    monkeypatch.setattr(s, "NARROW_ROWS", 10)
    assert narrow.exceptAll(stratified_split(df, "stratum", strict=False)).isEmpty()

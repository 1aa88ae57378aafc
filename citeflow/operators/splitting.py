"""Stratified three-way split with exact quotas.

Every stratum gets its share of the train rows by largest remainders, then its share of the test rows out of what is
left. Only the last stratum that still gets an extra row is looked up (one scalar per round); everything else is
arithmetic on the row's own stratum size. So the rows are shuffled once and never joined with a quota table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeflow.functions.hashing import seeded_hash
from citeflow.operators.numbering import HOT_ROWS, SMALL_LIMIT, count_groups, number_all, number_in_group
from citeflow.params import SplitRatios
from citeflow.session import materialise

# products of two row counts outgrow a bigint beyond this many rows
NARROW_ROWS = 3_000_000_000


def _number_type(total: int) -> str:
    return "bigint" if total <= NARROW_ROWS else "decimal(38,0)"


def ceil_share(n: int, share: tuple[int, int]) -> int:
    """ceil(n * a / b) in whole numbers."""
    a, b = share
    return -(-n * a // b)


def _share(size: Column, take: int, total: int) -> tuple[Column, Column]:
    """Whole part and remainder of size * take / total."""
    kind = _number_type(total)
    product = size.cast(kind) * F.lit(take).cast(kind)
    whole = F.lit(total).cast(kind)
    return F.call_function("div", product, whole), (product % whole).cast("decimal(38,0)" if kind != "bigint" else kind)


def _quota(size: Column, take: int, total: int, place: Column, cut: Column) -> Column:
    """Rows a stratum gives: its whole part, plus one when it is at or before the last stratum with an extra row."""
    part, rest = _share(size, take, total)
    extra = (rest > cut["rest"]) | ((rest == cut["rest"]) & (place <= cut["place"]))
    return part + F.coalesce(extra, F.lit(False)).cast("int")


def _last_extra(strata: DataFrame, take: int, total: int, seed: int, hot_rows: int) -> Column:
    """The last stratum with an extra row, in the order largest remainder, then hash: a struct (rest, place).

    A remainder depends on the stratum size alone and there are at most sqrt(2 N) different sizes, which bounds the
    one-partition window; strata with equal remainders are numbered in parallel.
    """
    part, rest = _share(F.col("_n"), take, total)
    parts = strata.select("_stratum", part.alias("_floor"), rest.alias("_rest"))
    falling = Window.orderBy(F.desc("_rest")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_rest = parts.groupBy("_rest").agg(F.count("*").alias("_m"), F.sum("_floor").alias("_floors"))
    running = by_rest.select(
        "_rest",
        (F.sum("_m").over(falling) - F.col("_m")).alias("_ahead"),
        "_m",
        (F.lit(take) - F.sum("_floors").over(Window.partitionBy())).alias("_extras"),
    )
    at = running.where((F.col("_extras") > F.col("_ahead")) & (F.col("_extras") <= F.col("_ahead") + F.col("_m"))).first()
    none = F.struct(F.lit(None).cast(_number_type(total)).alias("rest"), _literal_place(None, None).alias("place"))
    if at is None:
        return none
    tied = parts.where(F.col("_rest") == F.lit(at["_rest"]))
    need = int(at["_extras"] - at["_ahead"])
    if need <= SMALL_LIMIT:
        chosen = tied.select(_place("_stratum", seed).alias("p")).orderBy("p").limit(need).agg(F.max("p").alias("p"))
    else:
        numbered = number_all(tied, seed, "_stratum", "_number", hot_rows)
        chosen = numbered.where(F.col("_number") == need).select(_place("_stratum", seed).alias("p"))
    place = chosen.first()["p"]
    return F.struct(F.lit(at["_rest"]).cast(_number_type(total)).alias("rest"), _literal_place(place["hash"], place["stratum"]).alias("place"))


def _literal_place(digest: str | None, stratum: str | None) -> Column:
    return F.struct(F.lit(digest).cast("string").alias("hash"), F.lit(stratum).cast("string").alias("stratum"))


def _place(stratum: str, seed: int) -> Column:
    return F.struct(seeded_hash(seed, stratum).alias("hash"), F.col(stratum).cast("string").alias("stratum"))


def _check(strata: DataFrame, quotas: Column) -> None:
    """Raise where a stratified split is not possible; looks at one summary row."""
    row = (
        strata.withColumn("_q", quotas)
        .agg(
            F.count("*").alias("strata"),
            F.min("_n").alias("smallest"),
            F.sum(F.col("_q.train")).alias("train"),
            F.sum(F.col("_n") - F.col("_q.train")).alias("rest"),
            F.sum(F.col("_q.valid")).alias("valid"),
            F.sum(F.col("_q.test")).alias("test"),
            F.count_if(F.col("_n") > F.col("_q.train")).alias("rest_strata"),
            F.min(F.when(F.col("_n") > F.col("_q.train"), F.col("_n") - F.col("_q.train"))).alias("smallest_rest"),
        )
        .first()
    )
    if row.strata == 0:
        raise ValueError("nothing to split")
    if row.smallest < 2 or row.smallest_rest < 2:
        raise ValueError("a stratum has fewer than two rows to split")
    if min(row.train, row.rest) < row.strata or min(row.valid, row.test) < row.rest_strata:
        raise ValueError("a split has fewer rows than there are strata")


def stratified_split(
    df: DataFrame,
    stratum: str,
    ratios: SplitRatios = SplitRatios(),
    seed: int = 42,
    strict: bool = True,
    row_id: str = "row_id",
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: train, valid or test, in equal shares of every stratum.

    ``strict`` raises when a stratum is too small; otherwise strata of one row go to train whole. The stratum sizes
    are counted and kept in the checkpoint folder, and a few one-row summaries of them are read before the rows
    themselves are touched. ``counts`` (``_n`` per stratum) saves counting again.
    """
    counted = counts if counts is not None else count_groups(df, [stratum])
    counted = materialise(counted.withColumnRenamed(stratum, "_stratum"))
    strata = counted if strict else counted.where(F.col("_n") >= 2)

    seen = strata.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("all"), F.coalesce(F.max("_n"), F.lit(0)).alias("largest")).first()
    whole, largest = int(seen["all"]), max(1, seen["largest"])
    rest = ceil_share(whole, ratios.rest_fraction())
    test = ceil_share(rest, ratios.test_of_rest())
    first = (whole - rest, max(whole, 1))
    second = (test, max(rest, 1))

    def left_over(size: Column, name: str) -> Column:
        return size - _quota(size, *first, _place(name, seed), first_cut)

    first_cut = _last_extra(strata, *first, seed, hot_rows)
    after_train = strata.select("_stratum", left_over(F.col("_n"), "_stratum").alias("_n"))
    second_cut = _last_extra(after_train, *second, seed, hot_rows)

    def quotas(size: Column, name: str) -> Column:
        remaining = left_over(size, name)
        in_test = _quota(remaining, *second, _place(name, seed), second_cut)
        return F.struct((size - remaining).alias("train"), (remaining - in_test).alias("valid"), in_test.alias("test"))

    if strict:
        _check(strata, quotas(F.col("_n"), "_stratum"))

    sizes = counted.withColumnRenamed("_stratum", stratum)
    numbered = number_in_group(df, [stratum], seed, row_id, "_number", "_size", hot_rows, sizes, largest)
    numbered = numbered.withColumn("_quota", quotas(F.col("_size"), stratum))
    split = (
        F.when((F.col("_size") < 2) | (F.col("_number") <= F.col("_quota.train")), "train")
        .when(F.col("_number") <= F.col("_quota.train") + F.col("_quota.valid"), "valid")
        .otherwise("test")
    )
    return numbered.withColumn("split", split).drop("_number", "_size", "_quota")

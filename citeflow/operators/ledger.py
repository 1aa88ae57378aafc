"""A split that survives new rows: a ledger of assignments, extended batch by batch.

A stratum's rows are numbered in the order in which they arrive, and a row's split follows from its number alone: row
``k`` leaves train when the quota of rows outside train grows from ``k - 1`` to ``k`` rows, and goes to test when the
quota of test rows grows with it. So no row ever moves, and after every batch each stratum holds exactly the quotas of
its size. The quotas are shares rounded with an offset of the stratum's own, taken from a hash, so that many small
strata together come near the shares too. Use the same shares and seed for every batch.

A batch is written once, into a folder of its own, and sees earlier batches only: a batch that is run again after a
failure writes the same rows again.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.operators.joins import hot_keys, join_on_slices
from citeflow.operators.numbering import HOT_ROWS, number_in_group
from citeflow.params import SplitRatios
from citeflow.session import stored
from citeflow.sources.readers import read_cache

LEDGER = T.StructType(
    [
        T.StructField("row_id", T.StringType()),
        T.StructField("stratum", T.StringType()),
        T.StructField("number", T.LongType()),
        T.StructField("split", T.StringType()),
        T.StructField("batch_id", T.IntegerType()),
    ]
)


def _grown(rows: Column, share: tuple[int, int], stratum: Column, seed: int, name: str) -> Column:
    """How many of the first ``rows`` rows are given away: their share, rounded with the stratum's offset."""
    a, b = Fraction(*share).as_integer_ratio()
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.coalesce(stratum, F.lit(""))))
    offset = F.conv(F.substring(digest, 1, 8), 16, 10).cast("decimal(38,0)") % F.lit(b).cast("decimal(38,0)")
    whole = rows.cast("decimal(38,0)") * F.lit(a).cast("decimal(20,0)") + offset
    return F.call_function("div", whole, F.lit(b).cast("decimal(38,0)")).cast("bigint")


def quotas(size: Column, stratum: Column, ratios: SplitRatios = SplitRatios(), seed: int = 42) -> Column:
    """Rows of each split in a stratum of this size: a struct (train, valid, test)."""
    rest = _grown(size, ratios.rest_fraction(), stratum, seed, "rest")
    test = _grown(rest, ratios.test_of_rest(), stratum, seed, "test")
    return F.struct((size - rest).alias("train"), (rest - test).alias("valid"), test.alias("test"))


def split_of(number: Column, stratum: Column, ratios: SplitRatios = SplitRatios(), seed: int = 42) -> Column:
    """The split of the row with this number (from 1) in its stratum: the quota that grows with it."""
    now, before = quotas(number, stratum, ratios, seed), quotas(number - 1, stratum, ratios, seed)
    return (
        F.when(now["train"] > before["train"], "train").when(now["test"] > before["test"], "test").otherwise("valid")
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All assignments so far, one row per id; empty before the first batch."""
    return read_cache(spark, path, LEDGER)


def extend_ledger(
    rows: DataFrame,
    path: str,
    batch: int,
    stratum: str,
    ratios: SplitRatios = SplitRatios(),
    seed: int = 42,
    row_id: str = "row_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Assign the rows of one batch that no earlier batch holds; returns the ledger up to and with this batch.

    Rows without an id are left out. An id that comes several times counts once, in the least of its strata (no stratum
    only if it has none); an id of an earlier batch keeps its stratum and split. Rows without a stratum form one of
    their own. Other columns are ignored. Within a batch the order is the seeded hash of the id.
    """
    spark = rows.sparkSession
    before = read_ledger(spark, path).where(F.col("batch_id") < batch)
    named = rows.select(F.col(row_id).cast("string").alias("row_id"), F.col(stratum).cast("string").alias("stratum"))
    arrived = named.where(F.col("row_id").isNotNull()).groupBy("row_id").agg(F.min("stratum").alias("stratum"))
    new = stored(arrived.join(before.select("row_id"), "row_id", "left_anti"), "arrived")
    sizes = before.groupBy("stratum").agg(F.max("number").alias("_before"))
    numbered = number_in_group(new, ["stratum"], seed, "row_id", "_nth", hot_rows=hot_rows)
    placed = join_on_slices(numbered, sizes, "stratum", "left", hot_keys(new, "stratum", hot_rows), null_safe=True)
    number = F.coalesce("_before", F.lit(0)) + F.col("_nth")
    made = placed.select("row_id", "stratum", number.alias("number")).withColumn(
        "split", split_of(F.col("number"), F.col("stratum"), ratios, seed)
    )
    made.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")
    return read_ledger(spark, path).where(F.col("batch_id") <= batch)


def with_split(rows: DataFrame, ledger: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Add the ``split`` of each row's id; null where the ledger does not hold it. An existing column is replaced."""
    known = ledger.select(F.col("row_id").alias("_known"), F.col("split"))
    return rows.drop("split").join(known, F.col(row_id).cast("string") == F.col("_known"), "left").drop("_known")

"""Profiles and checks of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.functions.text import word_count
from citeflow.operators.dedup import distinct_keys
from citeflow.operators.ranking import topk_per_group
from citeflow.schemas import row_key

# fixed values: columns that tell where the right passage comes from
LEAKING = ("source_court", "source_date")


def assert_no_leakage(df: DataFrame, banned: tuple[str, ...] = LEAKING) -> DataFrame:
    """Fail when the data carries a column that is not known at retrieval time."""
    found = sorted(set(df.columns) & set(banned))
    if found:
        raise ValueError(f"columns not known at retrieval time: {found}")
    return df


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"))


def distinct_count(df: DataFrame, col: str, by: str = "split") -> DataFrame:
    """Distinct values per split; a missing value counts as one."""
    nulls = F.max(F.col(col).isNull().cast("int"))
    return df.groupBy(by).agg((F.countDistinct(col) + nulls).cast("bigint").alias("distinct_values"))


def value_share(df: DataFrame, col: str, top: int = 5, by: str = "split") -> DataFrame:
    """The most frequent values of each split and their share of its rows."""
    counts = df.where(F.col(col).isNotNull()).groupBy(by, col).agg(F.count("*").alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("_all"))
    best = topk_per_group(counts, top, by, "n", col)
    return best.join(totals, by).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "status")


def progress(worklist: DataFrame, cache: DataFrame, on: str = "dest_cite") -> DataFrame:
    """Distinct keys wanted, wanted and done, still to do, and all keys in the cache."""
    wanted = distinct_keys(worklist, on).select(on, F.lit(1).alias("_wanted"))
    done = distinct_keys(cache, on).select(on, F.lit(1).alias("_done"))
    both = wanted.join(done, on, "full")
    has_wanted, has_done = F.col("_wanted").isNotNull(), F.col("_done").isNotNull()
    return both.agg(
        F.count_if(has_wanted).alias("total"),
        F.count_if(has_wanted & has_done).alias("processed"),
        F.count_if(has_wanted & ~has_done).alias("remaining"),
        F.count_if(has_done).alias("cached"),
    )


def length_stats(df: DataFrame, col: str) -> DataFrame:
    """Mean and exact median of the number of words; the median works on one row per distinct length."""
    lengths = df.select(word_count(F.col(col)).alias("_words")).groupBy("_words").agg(F.count("*").alias("_n"))
    return lengths.agg(
        (F.sum(F.col("_words") * F.col("_n")) / F.sum("_n")).alias("mean_words"),
        F.percentile("_words", 0.5, F.col("_n")).alias("median_words"),
    )


def coverage(df: DataFrame, cols: list[str], by: str = "split") -> DataFrame:
    """Share of rows of each split that have a value; an empty list is no value."""

    def present(c: str):
        if isinstance(df.schema[c].dataType, T.ArrayType):
            return F.coalesce(F.size(c) > 0, F.lit(False))
        return F.col(c).isNotNull()

    return df.groupBy(by).agg(*[F.avg(present(c).cast("double")).alias(f"{c}_coverage") for c in cols])


def split_overlap(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """Contents found in more than one split, by digest, with the splits they are in."""
    found = df.select(row_key(df, key_cols).alias("content"), "split").groupBy("content").agg(F.collect_set("split").alias("_in"), F.count("*").alias("n_rows"))
    return found.where(F.size("_in") > 1).select("content", F.array_join(F.array_sort("_in"), ",").alias("splits"), "n_rows")


def batch_repeats(batches: DataFrame, col: str) -> DataFrame:
    """Values that occur more than once within one batch; for the column the batches were made by there are none."""
    counts = batches.groupBy("occurrence", "batch", col).agg(F.count("*").alias("n_rows"))
    return counts.where(F.col("n_rows") > 1)

"""Samples, shuffles and batches, all in seeded hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.functions.hashing import seeded_hash
from citeflow.operators.numbering import HOT_ROWS, count_groups, number_in_group
from citeflow.operators.selection import first_by_hash, first_by_value
from citeflow.session import materialise


def group_quota(size: Column, fraction: float, min_per_group: int = 0) -> Column:
    """Rows a group of the given size keeps: its share rounded half to even."""
    return F.greatest(F.bround(F.lit(float(fraction)) * size, 0), F.lit(float(min_per_group))).cast("bigint")


def sample_per_group(
    df: DataFrame,
    group: str,
    fraction: float,
    seed: int,
    min_per_group: int = 0,
    row_id: str = "row_id",
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Keep ``fraction`` of each group, rounded half to even; rows without a group are dropped.

    Small groups may vanish; ``min_per_group=1`` keeps every group. ``counts`` (``_n`` per group) saves counting again.
    """
    grouped = df.where(F.col(group).isNotNull())
    numbered = number_in_group(grouped, [group], seed, row_id, "_number", "_size", hot_rows, counts)
    quota = group_quota(F.col("_size"), fraction, min_per_group)
    return numbered.where(F.col("_number") <= quota).drop("_number", "_size")


def sample_n(df: DataFrame, n: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows without replacement, or all of them when there are fewer. ``row_id`` is unique."""
    return first_by_hash(df, n, seed, row_id)


def first_n(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """The first ``n`` rows by a unique order column."""
    return first_by_value(df, n, order_col)


def shuffle_rows(df: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    """Rows in seeded random order, for an export whose order matters."""
    return df.orderBy(seeded_hash(seed, row_id), row_id)


def assign_batches(
    df: DataFrame, key: str, size: int, seed: int, row_id: str = "row_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Put rows into batches of at most ``size`` in which no ``key`` occurs twice.

    ``occurrence`` numbers the rows of one key, so the rows of one occurrence have distinct keys and can be cut into
    batches freely; a batch is named by ``(occurrence, batch)``.
    """
    counts = materialise(count_groups(df, [key]))
    seen = number_in_group(df, [key], seed, row_id, "occurrence", None, hot_rows, counts)
    # the first occurrences are the largest group: one row of every key
    placed = number_in_group(seen, ["occurrence"], seed, row_id, "_place", None, hot_rows, largest=counts.count())
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("bigint")).drop("_place")

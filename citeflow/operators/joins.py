"""Joins of a large table with a keyed one, safe when one key holds a large part of the rows.

A hot key of the large side would send all its rows to one task. Its rows are spread over numbered slices instead, and
the matching rows of the other side are repeated once per slice. Only hot keys are treated so; when none is found the
join is Spark's plain one. No side is broadcast by hand: Catalyst does so by its size estimate, and AQE by the size seen
at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.operators.numbering import HOT_ROWS, count_groups, hot_groups, join_bounded


def hot_keys(df: DataFrame, on: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with too many rows for one task and the slices to spread them over, or None."""
    hot = hot_groups(count_groups(df, [on]), hot_rows)
    return hot.select(on, "_slices") if hot is not None else None


def join_spread(
    left: DataFrame,
    right: DataFrame,
    on: str,
    how: str = "left",
    null_safe: bool = False,
    hot_rows: int = HOT_ROWS,
    salt: Column | None = None,
) -> DataFrame:
    """Join on one column; ``how`` is inner, left, left_semi or left_anti.

    ``salt`` spreads the rows of a hot key, by default a hash of the whole row: the same on every retry, unlike a
    random number. Copies of one row stay together, so remove copies first (as the plans do) or leave them to AQE.
    """
    keys = left if null_safe else left.where(F.col(on).isNotNull())
    return join_on_slices(left, right, on, how, hot_keys(keys, on, hot_rows), null_safe, salt)


def join_on_slices(
    left: DataFrame, right: DataFrame, on: str, how: str, hot: DataFrame | None, null_safe: bool = False, salt: Column | None = None
) -> DataFrame:
    """The join itself, for hot keys that are known already."""
    other = f"_r_{on}"
    match = F.col(on).eqNullSafe(F.col(other)) if null_safe else F.col(on) == F.col(other)
    if hot is None:
        return left.join(right.withColumnRenamed(on, other), match, how).drop(other)
    salt = salt if salt is not None else F.xxhash64(*left.columns)
    spread = join_bounded(left, hot, [on]).withColumn(
        "_slice", F.coalesce(F.pmod(salt, F.col("_slices")).cast("int"), F.lit(0))
    )
    repeated = (
        join_bounded(right, hot, [on])
        .withColumn("_rslice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1)))
        .drop("_slices")
        .withColumnRenamed(on, other)
    )
    joined = spread.drop("_slices").join(repeated, match & (F.col("_slice") == F.col("_rslice")), how)
    return joined.drop(other, "_slice", "_rslice")

"""Distinct rows and keys, unions and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.schemas import row_key


def dedup_project(df: DataFrame, cols: list[str], row_id: str | None = None) -> DataFrame:
    """Drop rows that repeat in **all** columns, then keep ``cols``; so the result may repeat on ``cols``.

    Columns that are not kept take part as one digest, so only ``cols`` and the digest are shuffled. Copies are
    combined before the shuffle. ``row_id`` adds an identity that covers all columns, for sources without a key.
    """
    others = [c for c in df.columns if c not in cols]
    if not others:
        rows = df.select(*cols).distinct()
        return rows.withColumn(row_id, row_key(rows, cols)) if row_id else rows
    rows = df.select(*cols, row_key(df, others).alias("_others")).distinct()
    if row_id:
        rows = rows.withColumn(row_id, row_key(rows, [*cols, "_others"]))
    return rows.drop("_others")


def distinct_keys(df: DataFrame, col: str, order_col: str | None = None) -> DataFrame:
    """Non-null keys once each; with ``order_col`` also the position of their first occurrence."""
    keys = df.where(F.col(col).isNotNull()).withColumn(col, F.col(col).cast("string"))
    if order_col is None:
        return keys.select(col).distinct()
    return keys.groupBy(col).agg(F.min(order_col).alias(order_col))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def remaining(worklist: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Rows of the worklist whose key is not done yet."""
    return worklist.join(done.select(on).distinct(), on, "left_anti")


def uncovered(test: DataFrame, scraped: DataFrame, on: str) -> DataFrame:
    """Keys the test data needs and the scraped metadata lacks."""
    return remaining(distinct_keys(test, on), scraped, on)

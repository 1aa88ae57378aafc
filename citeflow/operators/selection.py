"""The first ``n`` rows of an order without sorting or numbering the table.

A histogram of the order's ranges tells which range holds the n-th row; only that range is looked into again, by finer
ranges, until it is small enough to sort. What comes out is a cut, and the selection itself is a filter on the table: no
row outside the last range is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.functions.hashing import seeded_hash
from citeflow.operators.numbering import SMALL_LIMIT, borders_up_to
from citeflow.schemas import exact_text

#: Hex digits of a digest that one histogram looks at (65,536 ranges), and borders of a histogram over values.
DIGITS, BORDERS = 4, 255


def _range_of(counts: DataFrame, n: int) -> tuple[object, int, int]:
    """The range that holds row ``n``, the rows before it and in it; ``counts`` (``_range``, ``_m``) has a bounded number of rows."""
    before = 0
    for row in counts.orderBy("_range").collect():
        if before + row["_m"] >= n:
            return row["_range"], before, row["_m"]
        before += row["_m"]
    raise AssertionError("the table has fewer rows than it had")


def first_by_hash(df: DataFrame, n: int, seed: int, row_id: str = "row_id", small: int = SMALL_LIMIT) -> DataFrame:
    """The first ``n`` rows in the order of ``md5(seed|row_id), row_id``, or all where there are fewer.

    Each look reads the keys once and counts them by the next ``DIGITS`` digits of the digest, within the range that
    holds the cut: 2**16 ranges divide even 10**12 rows into ranges that the next look or a sort of one range settles.
    """
    digest = seeded_hash(seed, row_id)
    keys = df.select(digest.alias("_hash"), F.col(row_id).alias("_id"))
    if n <= 0:
        return df.limit(0)
    if n <= small:
        return df.orderBy(digest, row_id).limit(n)
    prefix, need = "", n
    while len(prefix) < 32:
        inside = keys.where(F.col("_hash").startswith(prefix)) if prefix else keys
        counts = inside.groupBy(F.substring("_hash", len(prefix) + 1, DIGITS).alias("_range")).agg(F.count("*").alias("_m"))
        if not prefix and (counts.agg(F.sum("_m")).first()[0] or 0) <= n:
            return df
        digits, before, size = _range_of(counts, need)
        prefix, need = prefix + digits, need - before
        if size <= small:
            break
    else:
        raise ValueError(f"{row_id} is not unique")  # that many rows with one digest
    last = keys.where(F.col("_hash").startswith(prefix))
    cut = last.orderBy("_hash", "_id").limit(need).agg(F.max(F.struct("_hash", "_id")).alias("cut")).first()["cut"]
    up_to = F.col(row_id).isNull() | (F.col(row_id) <= F.lit(cut["_id"]).cast(df.schema[row_id].dataType))
    return df.where((digest < cut["_hash"]) | ((digest == cut["_hash"]) & up_to))


def first_by_value(df: DataFrame, n: int, order_col: str, small: int = SMALL_LIMIT) -> DataFrame:
    """The first ``n`` rows by a unique column, a null first, or all where there are fewer.

    The ranges of a look lie between the values with the smallest digests, a sample that is the same on every run; the
    range that holds the cut is about a 256th of the one before.
    """
    if n <= 0:
        return df.limit(0)
    if n <= small:
        return df.orderBy(order_col).limit(n)
    value, kind = F.col(order_col), df.schema[order_col].dataType
    seen = df.agg(F.count("*").alias("rows"), F.count_if(value.isNull()).alias("nulls")).first()
    if seen["rows"] <= n:
        return df
    if n <= seen["nulls"]:
        return df.where(value.isNull())
    inside, need, size = df.where(value.isNotNull()).select(value.alias("_key")), n - seen["nulls"], seen["rows"] - seen["nulls"]
    while size > small:
        sample = inside.orderBy(F.md5(exact_text(F.col("_key"), kind)), "_key").limit(BORDERS)
        borders = sorted(row["_key"] for row in sample.collect())
        if len(set(borders)) < len(borders):
            raise ValueError(f"{order_col} is not unique")
        listed = F.array(*[F.lit(b).cast(kind) for b in borders])
        ranged = inside.withColumn("_borders", listed).withColumn("_range", borders_up_to("_borders", "_key", BORDERS))
        place, before, size = _range_of(ranged.groupBy("_range").agg(F.count("*").alias("_m")), need)
        need -= before
        if place:
            inside = inside.where(F.col("_key") >= F.lit(borders[place - 1]).cast(kind))
        if place < len(borders):
            inside = inside.where(F.col("_key") < F.lit(borders[place]).cast(kind))
    cut = inside.orderBy("_key").limit(need).agg(F.max("_key")).first()[0]
    return df.where(value.isNull() | (value <= F.lit(cut).cast(kind)))

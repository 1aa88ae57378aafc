"""Exact row numbers without sending a large group, or the whole table, to one task.

A plain ``row_number() over (partition by g order by h)`` sorts each group in one task, which fails when one group
holds a large part of all rows. So the group sizes are looked at first (a count on the key column alone, combined
before its shuffle). Groups of at most ``hot_rows`` rows are numbered by that window. A larger group is cut into
slices that are known to be in order (ranges of the hash, or ranges between key values), each slice is numbered on its
own, and the number of rows in the slices before it is added. Either way the rows are shuffled once.

What is broadcast is bounded by construction: a group only counts as hot when it has more than 1/``MAX_SLICES`` of all
rows, so there are fewer than ``MAX_SLICES`` hot groups and fewer than ``2 * MAX_SLICES`` slices. Above ``MAX_SLICES *
hot_rows`` rows (1.6e10 by default) slices grow past ``hot_rows``; raise it with the memory of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeflow.functions.hashing import hash_slot, seeded_hash
from citeflow.schemas import exact_text
from citeflow.session import materialise

HOT_ROWS = 250_000
MAX_SLICES = 65_536
SPLITTERS = 255
RANGES = 4
SMALL_LIMIT = 10_000


def count_groups(df: DataFrame, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("_n"))


def hot_groups(counts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Groups too large for one task with the number of ``_slices`` to cut them into, or None; from ``_n`` per group.

    Fewer than ``MAX_SLICES`` rows whatever the data.
    """
    seen = counts.agg(F.sum("_n").alias("all"), F.max("_n").alias("largest")).first()
    limit = max(hot_rows, -(-(seen["all"] or 0) // MAX_SLICES))
    if (seen["largest"] or 0) <= limit:
        return None
    return materialise(counts.where(F.col("_n") > limit).withColumn("_slices", F.ceil(F.col("_n") / limit).cast("int")))


def join_bounded(df: DataFrame, small: DataFrame, cols: list[str]) -> DataFrame:
    """Left join, nulls equal, with a table of bounded size (hot groups or their slices)."""
    renamed = small.withColumnsRenamed({c: f"_k_{c}" for c in cols})
    match = F.lit(True)
    for c in cols:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(F.broadcast(renamed), match, "left").drop(*[f"_k_{c}" for c in cols])


def _rows_before(sizes: DataFrame, group: list[str]) -> DataFrame:
    """Rows in earlier slices; ``sizes`` has fewer than ``2 * MAX_SLICES`` rows."""
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*group, "_slice", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"))


def number_in_group(
    df: DataFrame,
    group: list[str],
    seed: int,
    row_id: str = "row_id",
    number: str = "number",
    size: str | None = None,
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Number the rows of each group 1.. in the order of ``md5(seed|row_id), row_id``; optionally add the group size.

    ``counts`` (``_n`` per group) or ``largest`` (no group is larger) save the look at the group sizes.
    """
    keyed = df.withColumn("_hash", seeded_hash(seed, row_id))
    hot = None
    if largest is None or largest > hot_rows:
        hot = hot_groups(counts if counts is not None else count_groups(df, group), hot_rows)
    if hot is None:
        piece = Window.partitionBy(*group)
        out = keyed.withColumn(number, F.row_number().over(piece.orderBy("_hash", row_id)).cast("bigint"))
        return (out.withColumn(size, F.count("*").over(piece)) if size else out).drop("_hash")

    keyed = join_bounded(keyed, hot, group)
    keyed = keyed.withColumn("_slice", F.coalesce(hash_slot(F.col("_hash"), F.col("_slices")), F.lit(0)))
    sizes = keyed.where(F.col("_slices").isNotNull()).groupBy(*group, "_slice").agg(F.count("*").alias("_m"))
    placed = join_bounded(keyed, _rows_before(sizes, group), [*group, "_slice"])
    piece = Window.partitionBy(*group, "_slice")
    out = placed.withColumn(
        number,
        F.row_number().over(piece.orderBy("_hash", row_id)).cast("bigint") + F.coalesce("_before", F.lit(0)),
    )
    if size:
        out = out.withColumn(size, F.coalesce("_n", F.count("*").over(piece)))
    return out.drop("_hash", "_n", "_slices", "_slice", "_before")


def number_all(
    df: DataFrame, seed: int, row_id: str = "row_id", number: str = "number", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Number all rows 1.. in the order of ``md5(seed|row_id), row_id``, in parallel over ranges of the hash."""
    rows = df.count()
    slices = max(1, -(-rows // max(hot_rows, -(-rows // MAX_SLICES))))
    keyed = df.withColumn("_hash", seeded_hash(seed, row_id))
    sliced = keyed.withColumn("_slice", hash_slot(F.col("_hash"), F.lit(slices)))
    return _number_slices(sliced, ["_hash", row_id], number, one=slices == 1).drop("_hash")


def number_by_value(
    df: DataFrame, key: Column, number: str = "number", hot_rows: int = HOT_ROWS, rows: int | None = None
) -> DataFrame:
    """Number all rows 1.. in the order of ``key``, which must be unique.

    Up to ``hot_rows`` rows are sorted in one task. More are numbered in parallel over ranges of the key, whose borders
    are the keys with the smallest hash: a random sample, yet the same on every run and every retry, so the two passes
    over the data agree. There are ``SPLITTERS`` borders at least and otherwise ``RANGES`` times as many as it takes
    ranges of ``hot_rows`` rows, up to ``MAX_SLICES``; each row finds its range by a binary search. Give it a stored
    frame, it is read more than once. ``rows`` is the number of rows, where it is known.
    """
    keyed = df.withColumn("_key", key)
    rows = df.count() if rows is None else rows
    if rows <= hot_rows:
        return _number_slices(keyed.withColumn("_slice", F.lit(0)), ["_key"], number, one=True).drop("_key")
    wanted = min(MAX_SLICES - 1, max(SPLITTERS, RANGES * -(-rows // hot_rows)))
    kind = keyed.schema["_key"].dataType
    sample = keyed.select("_key").orderBy(F.md5(exact_text(F.col("_key"), kind)), "_key").limit(wanted)
    borders = sample.agg(F.array_sort(F.collect_list("_key")).alias("_borders")).scalar()
    ranged = keyed.withColumn("_borders", borders).withColumn("_slice", borders_up_to("_borders", "_key", wanted))
    return _number_slices(ranged.drop("_borders"), ["_key"], number).drop("_key")


def borders_up_to(borders: str, key: str, at_most: int) -> Column:
    """How many of the ascending borders are not above the key, by halving the range that holds the answer."""

    def halve(found: Column, _: Column) -> Column:
        middle = F.floor((found["low"] + found["high"]) / 2).cast("int")
        below = (found["low"] < found["high"]) & (F.get(borders, middle) <= F.col(key))
        low = F.when(below, middle + 1).otherwise(found["low"])
        high = F.when(below | (found["low"] >= found["high"]), found["high"]).otherwise(middle)
        return F.struct(low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size(borders).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(at_most.bit_length()))
    return F.aggregate(steps, start, halve)["low"]


def _number_slices(sliced: DataFrame, order: list[str], number: str, one: bool = False) -> DataFrame:
    piece = Window.partitionBy("_slice").orderBy(*order)
    place = F.row_number().over(piece).cast("bigint")
    if one:
        return sliced.withColumn(number, place).drop("_slice")
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_m"))
    placed = join_bounded(sliced, _rows_before(sizes, []), ["_slice"])
    return placed.withColumn(number, place + F.coalesce("_before", F.lit(0))).drop("_slice", "_before")

"""A split that does not leak: contexts that are equal or nearly so stay on one side.

Rows whose texts are equal but for case and white space, or that share their first or last words, form a unit, and so
does whatever they are connected to. Units are placed whole, the largest first, each size in proportion to what the
splits still lack; the many small ones at the end fill the quotas up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.functions.text import collapse_ws
from citeflow.operators.graph import components
from citeflow.operators.joins import join_on_slices
from citeflow.operators.numbering import HOT_ROWS, hot_groups, number_in_group
from citeflow.operators.splitting import ceil_share
from citeflow.params import SplitRatios
from citeflow.session import stored

#: Words at either end that make two contexts one passage's.
EDGE_WORDS = 50
SPLITS = ("train", "valid", "test")


def normal_text(text: Column) -> Column:
    """A-Z as a-z, words joined by one space."""
    return collapse_ws(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def context_units(df: DataFrame, text: str, row_id: str = "row_id", edge_words: int = EDGE_WORDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(``row_id``, ``unit``): rows of a unit have equal or overlapping texts, or are connected by rows that have.

    A blank or missing text says nothing and is a unit of its own. Only digests are shuffled, copies of a text meet as
    one, and an edge that many texts share links them by a star and not by pairs. ``row_id`` is unique.
    """
    plain = normal_text(F.col(text))
    said = F.split(plain, " ")
    long_enough = F.size(said) >= edge_words
    edges = F.array(
        F.when(long_enough, F.md5(F.concat(F.lit("first|"), F.array_join(F.slice(said, 1, edge_words), " ")))),
        F.when(long_enough, F.md5(F.concat(F.lit("last|"), F.array_join(F.slice(said, -edge_words, edge_words), " ")))),
    )
    alone = F.md5(F.concat(F.lit("row|"), F.col(row_id).cast("string")))
    blank = F.coalesce(plain, F.lit("")) == ""
    rows = df.select(F.col(row_id), F.when(blank, alone).otherwise(F.md5(plain)).alias("node"), F.when(~blank, edges).alias("edges"))
    rows = stored(rows, "context-digests")
    nodes = rows.groupBy("node").agg(F.count("*").alias("_n"))
    edged = rows.select("node", F.explode("edges").alias("edge")).where("edge is not null").distinct()
    edged = stored(edged, "context-edges")
    shared = edged.groupBy("edge").agg(F.min("node").alias("low"), F.count("*").alias("_n"))
    hot = hot_groups(shared.select("edge", "_n"), hot_rows)
    shared = shared.where("_n > 1").select("edge", "low")
    links = join_on_slices(edged, shared, "edge", "inner", hot.select("edge", "_slices") if hot is not None else None)
    found = components(links.select(F.col("node").alias("a"), F.col("low").alias("b")))
    hot = hot_groups(nodes, hot_rows)
    joined = join_on_slices(rows.select(row_id, "node"), found.withColumnRenamed("id", "node"), "node", "left", hot.select("node", "_slices") if hot is not None else None, salt=F.xxhash64(row_id))
    return joined.select(row_id, F.coalesce("root", "node").alias("unit"))


def place_units(sizes: list[tuple[int, int]], quotas: tuple[int, int, int]) -> dict[int, tuple[int, int, int]]:
    """How many of the units of each size every split gets; ``sizes`` are (rows of a unit, such units).

    The largest first: each split gets its part of them by what it still lacks, whole units of the left over go to the
    split that lacks most. No split ends further from its quota than the largest unit is large.
    """
    lacks, out = list(quotas), {}
    for size, units in sorted(sizes, reverse=True):
        open_ = sum(max(x, 0) for x in lacks)
        given = [units * max(x, 0) // open_ if open_ else 0 for x in lacks]
        lacks = [x - g * size for x, g in zip(lacks, given)]
        for _ in range(units - sum(given)):
            most = max(range(3), key=lambda j: (lacks[j], -j))
            given[most] += 1
            lacks[most] -= size
        out[size] = tuple(given)
    return out


def split_units(
    df: DataFrame, units: DataFrame, ratios: SplitRatios = SplitRatios(), seed: int = 42, row_id: str = "row_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``split`` to the rows of ``df``: no unit (``row_id``, ``unit``) is in two splits.

    Units of one size are placed in the order of ``md5(seed|unit)``. There are at most sqrt(2 N) different sizes, so the
    table of sizes is small whatever the data; the units are numbered in parallel.
    """
    units = stored(units, "units")
    counted = stored(units.groupBy("unit").agg(F.count("*").alias("n")), "unit-sizes")
    by_size = [(r["n"], r["units"]) for r in counted.groupBy("n").agg(F.count("*").alias("units")).collect()]
    rows = sum(n * m for n, m in by_size)
    rest = ceil_share(rows, ratios.rest_fraction())
    test = ceil_share(rest, ratios.test_of_rest())
    placed = place_units(by_size, (rows - rest, rest - test, test))
    spark = df.sparkSession
    plan = spark.createDataFrame([(n, t, t + v) for n, (t, v, _) in placed.items()], "n long, train long, valid long")
    numbered = number_in_group(counted, ["n"], seed, "unit", "number", None, hot_rows).join(F.broadcast(plan), "n")
    side = F.when(F.col("number") <= F.col("train"), "train").when(F.col("number") <= F.col("valid"), "valid").otherwise("test")
    sides = numbered.select("unit", side.alias("split"))
    hot = hot_groups(counted.withColumnRenamed("n", "_n"), hot_rows)
    named = join_on_slices(units, sides, "unit", "inner", hot.select("unit", "_slices") if hot is not None else None, salt=F.xxhash64(row_id))
    return df.join(named.select(row_id, "split"), row_id)

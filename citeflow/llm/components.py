"""Connected components of a graph given as edges, by rounds of joins and aggregations on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.llm.frames import stored

#: Edges that one file of a stored round holds, about.
EDGES_A_FILE = 1_000_000


def _fingerprint(pairs: DataFrame) -> tuple[int, int, int]:
    hashed = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count("*"), F.bit_xor(hashed), F.sum(F.shiftright(hashed, 24))).first())


def connected_components(edges: DataFrame, source: str = "a", target: str = "b") -> DataFrame:
    """(``id``, ``component``) of every id that has an edge to another; the component is the smallest id reachable.

    Each round first hangs every id's larger neighbours on its smallest neighbour, then every id and its smaller
    neighbours on the smallest of them. Edges only ever shrink to stars, so the number of rounds grows with the
    logarithm of the longest path. Nothing but two ids travels per edge, minima are combined before each shuffle, and
    each round is stored, so a lost executor costs one round. Null ids and loops are left out.
    """
    a, b = F.col(source), F.col(target)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    pairs = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _fingerprint(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        down = large.join(lowest, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = down.unionByName(lowest.select("u", F.col("low").alias("v"))).distinct()
        pairs = stored(after.coalesce(max(8, before[0] // EDGES_A_FILE)), "stars")
        now = _fingerprint(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)

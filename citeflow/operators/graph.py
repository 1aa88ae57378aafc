"""Which rows belong together, directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.session import stored


def components(links: DataFrame) -> DataFrame:
    """(``id``, ``root``) of every id that ``links`` (``a``, ``b``) connects to another: the smallest id reachable.

    Alternates two steps on stored tables until nothing moves: every larger neighbour of an id is hung on its smallest
    neighbour, then every smaller one. Both keep what is connected connected, minima are combined before each shuffle,
    and the rounds grow with the logarithm of the longest chain.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        near = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        outer = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        least = outer.groupBy("a").agg(F.min("b").alias("low"))
        inner = outer.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = stored(inner.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 20))).first())

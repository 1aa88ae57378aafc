"""Ranking over long rows ``(query_id, cand_id, score)``: what any scorer hands over, and where metrics start.

Higher scores come first, equal scores by ascending ``cand_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeflow.operators.joins import hot_keys, join_on_slices, join_spread
from citeflow.operators.numbering import HOT_ROWS


def topk_per_group(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", cand: str = "cand_id") -> DataFrame:
    """The ``k`` best rows of each group with their ``rank``; each task keeps its own best ``k`` before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(cand))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def argmax_per_group(scores: DataFrame, by: str = "query_id") -> DataFrame:
    return topk_per_group(scores, 1, by).drop("rank")


def rank_of_truth(scores: DataFrame, truth: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based rank of the right candidate of each query, -1 where it is not among the candidates.

    ``truth`` has one row ``(query_id, truth_id)`` per query. Counting the better candidates needs no sort.
    """
    hot = hot_keys(scores, "query_id", hot_rows)
    named = truth.select("query_id", "truth_id", F.col("truth_id").alias("cand_id"))
    right = scores.join(named, ["query_id", "cand_id"]).select("query_id", "truth_id", F.col("score").alias("_right"))
    compared = join_on_slices(scores, right, "query_id", "inner", hot)
    ahead = (F.col("score") > F.col("_right")) | ((F.col("score") == F.col("_right")) & (F.col("cand_id") < F.col("truth_id")))
    ranks = compared.groupBy("query_id").agg((F.count_if(ahead) + 1).alias("rank"))
    return truth.select("query_id").join(ranks, "query_id", "left").withColumn("rank", F.coalesce("rank", F.lit(-1).cast("bigint")))


def restricted_softmax(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add ``prob``: softmax of each query's scores over the given candidates only; other rows are left out.

    A query has at most one row per candidate, so a window never holds more rows than there are candidates.
    """
    kept = scores.join(candidates.select("cand_id").distinct(), "cand_id", "left_semi")
    query = Window.partitionBy("query_id")
    mass = F.exp(F.col("score") - F.max("score").over(query))
    return kept.withColumn("_mass", mass).withColumn("prob", F.col("_mass") / F.sum("_mass").over(query)).drop("_mass")


def ground_truth(pairs: DataFrame, relevance: str = "passage", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Right candidate of each pair's question.

    ``row``: the pair's own answer, even when another row holds the same text. ``passage``: one candidate per answer
    text, named by its smallest pair id.
    """
    if relevance == "row":
        return pairs.select(F.col("pair_id").alias("query_id"), F.col("pair_id").alias("truth_id"))
    if relevance != "passage":
        raise ValueError("relevance must be 'row' or 'passage'")
    firsts = pairs.groupBy("answer").agg(F.min("pair_id").alias("truth_id"))
    named = join_spread(pairs.select("pair_id", "answer"), firsts, "answer", "inner", hot_rows=hot_rows)
    return named.select(F.col("pair_id").alias("query_id"), "truth_id")


def distinct_answers(pairs: DataFrame) -> DataFrame:
    """The corpus that belongs to ``relevance='passage'``: every answer text once."""
    return pairs.groupBy("answer").agg(F.min("pair_id").alias("cand_id")).select("cand_id", "answer")

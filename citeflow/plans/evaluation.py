"""Evaluations end to end: from vectors or scores to reported numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.operators.embedding import embed
from citeflow.operators.metrics import ACCURACY_KS, ir_metrics, topk_accuracy
from citeflow.operators.ranking import distinct_answers, ground_truth, rank_of_truth
from citeflow.operators.retrieval import retrieval_ranks
from citeflow.session import materialise


def evaluate_scores(scores: DataFrame, truth: DataFrame, ks: tuple[int, ...] = ACCURACY_KS) -> DataFrame:
    """Top-k accuracy of any scorer's rows ``(query_id, cand_id, score)``."""
    return topk_accuracy(rank_of_truth(scores, truth), ks)


def evaluate_vectors(queries: DataFrame, corpus: DataFrame, truth: DataFrame, ks: tuple[int, ...] = ACCURACY_KS, block_rows: int | None = None) -> DataFrame:
    """Top-k accuracy of nearest-neighbour retrieval."""
    return topk_accuracy(retrieval_ranks(queries, corpus, truth, block_rows=block_rows), ks)


def evaluate_ir(queries: DataFrame, corpus: DataFrame, truth: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The ranking metrics of nearest-neighbour retrieval."""
    return ir_metrics(retrieval_ranks(queries, corpus, truth, block_rows=block_rows))


def ranks_of_pairs(
    pairs: DataFrame, load: Callable[[], Callable], dim: int, relevance: str = "passage", block_rows: int | None = None
) -> DataFrame:
    """Ranks of the right passages for question-answer texts ``(pair_id, question, answer)``, encoded by a model.

    The vectors are kept, since encoding is the costly part and they are read more than once. With
    ``relevance="passage"`` each answer text is one candidate and encoded once.
    """
    if relevance == "passage":
        answers = distinct_answers(pairs)
    else:
        answers = pairs.select(F.col("pair_id").alias("cand_id"), "answer")
    asked = embed(pairs.select(F.col("pair_id").alias("query_id"), "question"), "question", load, dim)
    queries = materialise(asked.select("query_id", "vec"))
    corpus = materialise(embed(answers, "answer", load, dim).select("cand_id", "vec"))
    return retrieval_ranks(queries, corpus, ground_truth(pairs, relevance), block_rows=block_rows)

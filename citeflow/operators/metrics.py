"""Accuracy and ranking metrics from ranks; a rank of -1 (not found) is a miss, no rows give nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: cut-offs of the reported accuracies and of the ranking metrics
ACCURACY_KS = (1, 5, 10)
IR_KS = (1, 3, 5, 10)
MRR_K = 10
NDCG_K = 10
MAP_K = 100


def _hit(k: int):
    return (F.col("rank") > 0) & (F.col("rank") <= k)


def _share(condition):
    return F.avg(condition.cast("double"))


def accuracy(preds: DataFrame) -> DataFrame:
    """Share of rows whose ``pred`` equals ``truth``."""
    return preds.agg(_share(F.col("pred") == F.col("truth")).alias("accuracy"), F.count("*").alias("evaluated"))


def topk_accuracy(ranks: DataFrame, ks: tuple[int, ...] = ACCURACY_KS) -> DataFrame:
    return ranks.agg(*[_share(_hit(k)).alias(f"top_{k}_accuracy") for k in ks], F.count("*").alias("evaluated"))


def ir_metrics(ranks: DataFrame) -> DataFrame:
    """Accuracy, precision and recall at k, MRR, NDCG and MAP for one right passage per query."""
    rank = F.col("rank").cast("double")

    def at(k: int, gain):
        return F.avg(F.when(_hit(k), gain).otherwise(F.lit(0.0)))

    shares = [
        column
        for k in IR_KS
        for column in (
            _share(_hit(k)).alias(f"accuracy_at_{k}"),
            at(k, F.lit(1.0) / k).alias(f"precision_at_{k}"),
            _share(_hit(k)).alias(f"recall_at_{k}"),
        )
    ]
    return ranks.agg(
        *shares,
        at(MRR_K, 1 / rank).alias(f"mrr_at_{MRR_K}"),
        at(NDCG_K, 1 / F.log2(rank + 1)).alias(f"ndcg_at_{NDCG_K}"),
        at(MAP_K, 1 / rank).alias(f"map_at_{MAP_K}"),
        F.count("*").alias("evaluated"),
    )

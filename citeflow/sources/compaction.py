"""A cache that stays cheap to read: a snapshot of the newest attempts, and the batches written since.

Batches are appended to ``path`` as before. A compaction writes the newest attempt of each key up to a batch into a folder
beside it and then one line to the manifest. Readers take the newest snapshot the manifest names and the later batches
only. Nothing is deleted or overwritten once it is named, so a compaction that breaks off at any point loses nothing
and can be run again. Compact only batches that are finished: one that is replayed later would not be seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.operators.dedup import union_all
from citeflow.operators.enrichment import latest_attempt
from citeflow.sources.readers import read_cache

MANIFEST = T.StructType([T.StructField("upto", T.LongType())])


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}-compacted"


def newest_snapshot(spark: SparkSession, path: str) -> int | None:
    """The last batch that the newest finished snapshot covers; from one number a compaction."""
    named = read_cache(spark, f"{_beside(path)}/manifest", MANIFEST)
    return named.agg(F.max("upto")).first()[0]


def read_newest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest attempt of each key; ``schema`` has ``dest_cite`` and ``batch_id``. Empty before the first batch."""
    return _newest(spark, path, schema, None)


def _newest(spark: SparkSession, path: str, schema: T.StructType, upto: int | None) -> DataFrame:
    batches = read_cache(spark, path, schema)
    if upto is not None:
        batches = batches.where(F.col("batch_id") <= upto)
    covered = newest_snapshot(spark, path)
    if covered is None:
        return latest_attempt(batches)
    snapshot = spark.read.schema(schema).parquet(f"{_beside(path)}/rows/{covered}")
    return latest_attempt(union_all(snapshot, batches.where(F.col("batch_id") > covered)))


def compact_cache(spark: SparkSession, path: str, upto: int, schema: T.StructType) -> bool:
    """Write a snapshot of the batches up to ``upto`` from the one before and the batches since; False if there is one."""
    covered = newest_snapshot(spark, path)
    if covered is not None and covered >= upto:
        return False
    _newest(spark, path, schema, upto).write.mode("overwrite").parquet(f"{_beside(path)}/rows/{upto}")
    spark.createDataFrame([(upto,)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{_beside(path)}/manifest")
    return True

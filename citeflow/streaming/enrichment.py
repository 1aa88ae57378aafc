"""Metadata collection as a streaming job over arriving citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from citeflow.operators.enrichment import Lookup, parse_lookup, to_do
from citeflow.schemas import METADATA
from citeflow.sources.readers import read_cache
from citeflow.sources.writers import append_cache

CACHE = T.StructType([*METADATA.fields, T.StructField("batch_id", T.LongType())])


def enrich_batch(arrived: DataFrame, lookup: Lookup, cache_path: str, batch_id: int, retry_statuses: tuple[str, ...] = ()) -> None:
    """Look up the keys of one batch that no earlier batch settled.

    Only earlier batches count as done and the batch's own rows are replaced, so a replay gives the same rows.
    """
    cache = read_cache(arrived.sparkSession, cache_path, CACHE)
    earlier = cache.where(F.col("batch_id") < batch_id)
    append_cache(parse_lookup(lookup(to_do(arrived, earlier, retry_statuses))), cache_path, batch_id)


def start_enrichment(
    arriving: DataFrame, lookup: Lookup, cache_path: str, checkpoint: str, retry_statuses: tuple[str, ...] = ()
) -> StreamingQuery:
    """Process everything that has arrived since the last run, then stop."""

    def each(batch: DataFrame, batch_id: int) -> None:
        enrich_batch(batch, lookup, cache_path, batch_id, retry_statuses)

    return (
        arriving.select("dest_cite")
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_enriched(spark: SparkSession, cache_path: str) -> DataFrame:
    return read_cache(spark, cache_path, CACHE)

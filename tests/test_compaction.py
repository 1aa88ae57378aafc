"""Snapshots of the cache."""

import pytest
from pyspark.sql import types as T

from citeflow.sources import compaction

SCHEMA = T.StructType([T.StructField("dest_cite", T.StringType()), T.StructField("status", T.StringType()), T.StructField("batch_id", T.LongType())])
BATCHES = [[("a", "late"), ("b", "ok")], [("a", "late"), ("c", "late")], [("a", "ok"), (None, "error")], []]


def put(spark, path, batch):
    spark.createDataFrame(BATCHES[batch], "dest_cite string, status string").write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def newest(spark, path):
    return {r.dest_cite: (r.status, r.batch_id) for r in compaction.read_newest(spark, path, SCHEMA).collect()}


def test_equal_rows_before_and_after(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert newest(spark, path) == {}
    for batch in range(4):
        put(spark, path, batch)
        before = newest(spark, path)
        assert compaction.compact_cache(spark, path, batch, SCHEMA)
        assert not compaction.compact_cache(spark, path, batch, SCHEMA)
        assert newest(spark, path) == before
    assert before == {"a": ("ok", 2), "b": ("ok", 0), "c": ("late", 1), None: ("error", 2)}


def test_covered_batches_are_not_read_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    for batch in range(3):
        put(spark, path, batch)
    compaction.compact_cache(spark, path, 1, SCHEMA)
    files = compaction.read_newest(spark, path, SCHEMA)
    text = files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in text and "batch_id#" in text
    assert newest(spark, path)["c"] == ("late", 1) and newest(spark, path)["a"] == ("ok", 2)


def test_a_compaction_broken_off_between_its_steps_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    for batch in range(3):
        put(spark, path, batch)
    compaction.compact_cache(spark, path, 0, SCHEMA)
    before = newest(spark, path)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as broken:
        broken.setattr(type(spark), "createDataFrame", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            compaction.compact_cache(spark, path, 2, SCHEMA)
    assert compaction.newest_snapshot(spark, path) == 0 and newest(spark, path) == before
    assert compaction.compact_cache(spark, path, 2, SCHEMA) and newest(spark, path) == before

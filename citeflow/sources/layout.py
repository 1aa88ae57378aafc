"""Tables laid out once by their join key, so that joins on it shuffle neither side.

A laid-out table is a folder of Parquet files bucketed and sorted by the key, one file a bucket. Two tables with equally
many buckets join bucket by bucket. A key that holds too many rows for one task would fill one bucket: the rows of such
keys are kept apart, in files of any number, and meet the rows of the other side by a broadcast of the few that have
these keys, where their measured size allows it, otherwise by the join that spreads hot keys.

The frame that is given is read once to count its keys and once or, with hot keys, twice to write it. The folder's
description is written last: a layout that was broken off cannot be opened.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.operators.dedup import union_all
from citeflow.operators.joins import join_on_slices
from citeflow.operators.numbering import HOT_ROWS, count_groups, hot_groups, join_bounded

#: Most bytes (as JSON text) of the rows that are broadcast to meet a hot key's rows.
BROADCAST_BYTES = 64_000_000


@dataclass(frozen=True)
class LaidOut:
    """A laid-out table: ``rows`` apart from hot keys, the rows of ``hot_keys`` and those keys, both None without any."""

    key: str
    buckets: int
    unique: bool
    rows: DataFrame
    hot_rows: DataFrame | None = None
    hot_keys: DataFrame | None = None

    def all_rows(self) -> DataFrame:
        return self.rows if self.hot_rows is None else union_all(self.rows, self.hot_rows)


def _table(path: str) -> str:
    return f"laid_out_{hashlib.md5(path.encode()).hexdigest()}"


def write_laid_out(
    df: DataFrame, path: str, key: str, buckets: int | None = None, unique: bool = False, hot_rows: int = HOT_ROWS
) -> LaidOut:
    """Lay a table out in the empty folder ``path``, which every executor reaches.

    ``buckets`` defaults to the session's shuffle partitions; give the two sides of a join the same number. ``unique``
    demands that no key comes twice (rows without a key aside) and lets a join rely on it.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = count_groups(df, [key])
    if unique:
        twice = counts.where((F.col("_n") > 1) & F.col(key).isNotNull()).limit(5).collect()
        if twice:
            raise ValueError(f"keys that come more than once, for example {[r[key] for r in twice]}")
    hot = hot_groups(counts, hot_rows)
    cold = df
    if hot is not None:
        hot.write.parquet(f"{path}/hot_keys")
        flagged = join_bounded(df, hot.select(key, "_slices"), [key])
        flagged.where(F.col("_slices").isNotNull()).drop("_slices").write.parquet(f"{path}/hot")
        cold = flagged.where(F.col("_slices").isNull()).drop("_slices")
    name = _table(path)
    spark.sql(f"drop table if exists {name}")
    bucketed = cold.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    bucketed.format("parquet").option("path", f"{path}/rows").saveAsTable(name)
    about = [(key, buckets, unique, hot is not None, df.schema.json())]
    spark.createDataFrame(about, "key string, buckets int, unique boolean, hot boolean, columns string").write.json(f"{path}/about")
    return open_laid_out(spark, path)


def open_laid_out(spark: SparkSession, path: str) -> LaidOut:
    """Open a folder written by ``write_laid_out``, also in another session."""
    about = spark.read.schema("key string, buckets int, unique boolean, hot boolean, columns string").json(f"{path}/about").first()
    if about is None:
        raise ValueError(f"{path} holds no finished layout")
    schema = T.StructType.fromJson(json.loads(about.columns))
    name = _table(path)
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    key = _quoted(about.key)
    spark.sql(
        f"create table if not exists {name} ({columns}) using parquet "
        f"clustered by ({key}) sorted by ({key}) into {about.buckets} buckets location '{path}/rows'"
    )
    hot, keys = None, None
    if about.hot:
        hot = spark.read.schema(schema).parquet(f"{path}/hot")
        keys = spark.read.parquet(f"{path}/hot_keys").select(about.key, "_slices")
    return LaidOut(about.key, about.buckets, about.unique, spark.table(name), hot, keys)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def join_laid_out(left: LaidOut, right: LaidOut, how: str = "left") -> DataFrame:
    """Join on the key both tables are laid out by; ``how`` is inner, left, left_semi or left_anti.

    The right table must be unique in its key, so no row of the left comes twice. Rows without a key match nothing. The
    left table is read once and not shuffled, unless the right rows of its hot keys exceed ``BROADCAST_BYTES``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a join of kind {how!r} is not made on laid-out tables")
    if not right.unique or left.key != right.key or left.buckets != right.buckets:
        raise ValueError("lay both tables out by one key in equally many buckets, the right one unique")
    key, other = left.key, f"_r_{left.key}"

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed(key, other)

    def joined(rows: DataFrame, to: DataFrame) -> DataFrame:
        return rows.join(to, F.col(key) == F.col(other), how).drop(other)

    # a right row without a key, the only one that may be repeated and so stored apart, matches nothing
    cold = joined(left.rows, renamed(right.rows))
    if left.hot_rows is None:
        return cold
    needed = right.rows.join(F.broadcast(left.hot_keys.select(key)), key, "left_semi")
    size = needed.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        hot = joined(left.hot_rows, F.broadcast(renamed(needed)))
    else:
        hot = join_on_slices(left.hot_rows, needed, key, how, left.hot_keys)
    return union_all(cold, hot)

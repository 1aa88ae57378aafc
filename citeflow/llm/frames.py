"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.session import scratch_dir


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col(f"`{name.replace('`', '``')}`")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute a frame once as Parquet in the shared checkpoint folder; unlike a checkpoint it keeps columns prunable."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def label_share(key: str) -> Column:
    """crc32 of the key as text, modulo 5; rows with 0 are held out of all learning."""
    return F.crc32(col(key).cast("string").cast("binary")) % 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_batch(run: Callable, kind: str, column: Column | str) -> Column:
    """``run`` maps an iterator of Arrow arrays, one a batch of the column, to an iterator of result arrays.

    The result counts as non-deterministic for the optimizer, which then neither evaluates it twice nor moves it.
    """

    def tidy(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)
        give_back()

    tidy.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy, kind).asNondeterministic()(column)


def give_back() -> None:
    """Return freed memory to the machine at the end of a task: its Python worker lives on, idle or with other work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library

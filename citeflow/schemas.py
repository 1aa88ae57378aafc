"""Declared schemas of the tables that are read and written, and helpers that shape a frame to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


LABEL_MAP = T.StructType(
    [
        T.StructField("passage_id", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("label_idx", T.IntegerType()),
    ]
)

MESSAGES = T.ArrayType(_strings("role", "content"))

CHAT = T.StructType([T.StructField("messages", MESSAGES)])

PAIRS = _strings("question", "answer")

# fixed values: column order of the metadata table
METADATA = T.StructType(
    [
        T.StructField("dest_cite", T.StringType()),
        T.StructField("case_name", T.StringType()),
        T.StructField("court", T.StringType()),
        T.StructField("date_filed", T.StringType()),
        T.StructField("opinion_id", T.LongType()),
        T.StructField("cluster_id", T.LongType()),
        T.StructField("author_judge", T.StringType()),
        T.StructField("judge_names", T.ArrayType(T.StringType())),
        T.StructField("panel_text", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("lookup_matches", T.IntegerType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in its order and types; a column the frame lacks becomes null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


EXACT = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def exact_text(value: Column, kind: T.DataType) -> Column:
    """A value as text that differs where the values do: timestamps to the microsecond, -0.0 as 0.0 at any depth."""
    return F.to_json(F.struct(_one_zero(value, kind).alias("v")), EXACT)


def _one_zero(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value + F.lit(0.0)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _one_zero(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [_one_zero(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def row_key(df: DataFrame, columns: list[str]) -> Column:
    """Identity of a row of ``df`` from its values: equal exactly where the values are, nulls included."""
    values = [_one_zero(F.col(c), df.schema[c].dataType).alias(c) for c in columns]
    return F.sha2(F.to_json(F.struct(*values), EXACT), 256)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add a row id that survives repartitioning, for sources without a key. Needs duplicate-free rows."""
    return df.withColumn(name, row_key(df, df.columns))

"""Readers with declared schemas. Formats that one task must read whole (gzip, one JSON document) are imported once
and kept as Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.functions.text import strip_ws
from citeflow.operators.labels import encode_labels, with_label_index
from citeflow.schemas import CHAT, LABEL_MAP, PAIRS
from citeflow.session import materialise

# quotes inside quoted text are doubled, text may hold line breaks, and its outer blanks belong to it
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def spread_few_files(df: DataFrame) -> DataFrame:
    """Deal the rows out evenly when a table is read by fewer tasks than the session has cores.

    A small file, or one that cannot be split, is read by one task, which would then also do all the work on its rows.
    A large table is read by more tasks than that and nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_csv(spark: SparkSession, path: str | list[str], cols: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """CSV by header names; the codec follows the file name. Without a schema every column is text."""
    reader = spark.read.options(**CSV_OPTIONS)
    # names come from the header and types stay text: nothing is inferred
    df = reader.option("inferSchema", "false").csv(path) if schema is None else reader.schema(schema).csv(path)
    return df.select(*cols) if cols else df


def read_contexts(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, partitions: int | None = None) -> DataFrame:
    """Contexts from (compressed) CSV: all columns of the file by name, since removing copies looks at all of them, or
    exactly the columns of ``schema`` in file order. ``partitions`` spreads files that cannot be split."""
    df = read_csv(spark, path, schema=schema)
    return df.repartition(partitions) if partitions else spread_few_files(df)


def read_metadata(spark: SparkSession, paths: list[str], cols: tuple[str, ...] = ("dest_cite", "judge_names")) -> DataFrame:
    """A few columns of several metadata files, one under the other."""
    return read_csv(spark, list(paths), list(cols))


def read_keys(spark: SparkSession, path: str | list[str], col: str = "dest_cite") -> DataFrame:
    return read_csv(spark, path, [col])


def _read_map(spark: SparkSession, path: str, key: str, value: str, field: str | None = None) -> DataFrame:
    """A JSON object of text to text, optionally below one field, as rows."""
    if field is None:
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))
    schema = T.StructType().add(field, T.MapType(T.StringType(), T.StringType()))
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode(field).alias(key, value))


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Passage texts from the dictionary file: one JSON object with the texts below ``data``."""
    return _read_map(spark, path, "passage_id", "passage", "data")


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """The label map as this package keeps it (Parquet), or imported from its JSON form (id to token)."""
    if not path.endswith(".json"):
        return spark.read.schema(LABEL_MAP).parquet(path)
    return with_label_index(materialise(_read_map(spark, path, "passage_id", "token")))


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Conversations, one JSON object per line; a record without ``messages`` fails, whichever it is.

    Records are looked through once for this, and each is checked again as it is read, for files that arrive later.
    """
    rows = spark.read.schema(CHAT).json(path)
    if rows.where(F.col("messages").isNull()).take(1):
        raise KeyError("chat records need a 'messages' field")
    missing = F.raise_error(F.lit("chat records need a 'messages' field"))
    return rows.select(F.when(F.col("messages").isNotNull(), F.col("messages")).otherwise(missing).alias("messages"))


def read_chat_document(spark: SparkSession, path: str) -> DataFrame:
    """Import of the one-document form ``{"messages": [[{role, content}, ..], ..]}``, a row per conversation."""
    schema = T.StructType().add("messages", T.ArrayType(CHAT["messages"].dataType))
    document = spark.read.schema(schema).option("multiLine", "true").json(path)
    if document.where(F.col("messages").isNull()).take(1):
        raise KeyError("chat records need a 'messages' field")
    return document.select(F.posexplode("messages").alias("sample_id", "messages"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Question-answer pairs, one JSON object per line."""
    return spark.read.schema(PAIRS).json(path)


def read_pairs_document(spark: SparkSession, path: str) -> DataFrame:
    """Import of the parallel-array form ``{"queries": [..], "paragraphs": [..]}``; unequal lengths fail."""
    texts = T.ArrayType(T.StringType())
    schema = T.StructType().add("queries", texts).add("paragraphs", texts)
    document = spark.read.schema(schema).option("multiLine", "true").json(path)
    same = F.size("queries") == F.size("paragraphs")
    zipped = F.when(same, F.arrays_zip("queries", "paragraphs")).otherwise(F.raise_error(F.lit("queries and paragraphs differ in length")))
    rows = document.select(F.posexplode(zipped).alias("pair_id", "_pair"))
    return rows.select("pair_id", F.col("_pair.queries").alias("question"), F.col("_pair.paragraphs").alias("answer"))


def read_examples(spark: SparkSession, path: str, text_col: str, label_map: DataFrame | None = None) -> DataFrame:
    """Classifier examples ``(input_text, label)`` from a split file; rows whose label is not in the map are left out."""
    rows = read_csv(spark, path, ["passage_id", text_col]).withColumn("input_text", strip_ws(F.col(text_col)))
    if label_map is None:
        return rows.select("input_text", F.col("passage_id").alias("label"))
    return encode_labels(rows, label_map, missing="drop").select("input_text", F.col("label_idx").alias("label"))


def read_cache(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table kept at ``path``, or an empty one when nothing was written yet; other errors are not hidden."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)

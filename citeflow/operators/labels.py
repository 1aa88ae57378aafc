"""The label space: passages as numbered tokens and as class indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.operators.joins import join_spread
from citeflow.operators.numbering import HOT_ROWS, number_by_value
from citeflow.session import materialise

# fixed value: spelling of a label token
TOKEN_LAYOUT = "<special_token_{n}>"


def build_label_map(df: DataFrame, id_col: str = "passage_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per passage: ``token`` numbers the ids in byte order from 1, ``label_idx`` in the order of the number
    after their last underscore from 0 (equal numbers in byte order).

    The map is made once and kept: training, encoding and evaluation must all read the same one.
    """
    ids = df.select(F.col(id_col).cast("string").alias("passage_id")).where(F.col(id_col).isNotNull()).distinct()
    ids = materialise(ids)
    rows = ids.count()
    before, after = TOKEN_LAYOUT.split("{n}")
    token = F.concat(F.lit(before), F.col("_token").cast("string"), F.lit(after))
    tokens = number_by_value(ids, F.col("passage_id"), "_token", hot_rows, rows).select("passage_id", token.alias("token"))
    return with_label_index(tokens if rows <= hot_rows else materialise(tokens), hot_rows, rows)


def with_label_index(tokens: DataFrame, hot_rows: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Add the zero-based class index to the rows ``(passage_id, token)``; ids that do not end in a number come last."""
    suffix = F.element_at(F.split("passage_id", "_"), -1).try_cast("bigint")
    order = F.struct(suffix.isNull().alias("none"), suffix.alias("n"), F.col("passage_id").alias("id"))
    indexed = number_by_value(tokens, order, "_idx", hot_rows, rows)
    return materialise(indexed.select("passage_id", "token", (F.col("_idx") - 1).cast("int").alias("label_idx")))


def unknown_labels(df: DataFrame, label_map: DataFrame) -> DataFrame:
    """Ids in the data that the label map lacks."""
    return df.select(F.col("passage_id").cast("string")).distinct().join(label_map, "passage_id", "left_anti")


def encode_labels(df: DataFrame, label_map: DataFrame, missing: str = "error", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``token`` and ``label_idx``. Rows without a label fail the job (``error``) or are left out (``drop``)."""
    keyed = df.withColumn("passage_id", F.col("passage_id").cast("string"))
    if missing == "drop":
        return join_spread(keyed, label_map, "passage_id", "inner", hot_rows=hot_rows)
    if missing != "error":
        raise ValueError("missing must be 'error' or 'drop'")
    lost = unknown_labels(keyed, label_map).limit(5).collect()
    if lost:
        raise KeyError(f"passages without a label, for example {[r.passage_id for r in lost]}")
    return join_spread(keyed, label_map, "passage_id", "left", hot_rows=hot_rows)


def decode_labels(df: DataFrame, label_map: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the ``passage_id`` of each ``label_idx``."""
    return join_spread(df, label_map.select("label_idx", "passage_id"), "label_idx", "left", hot_rows=hot_rows)


def check_label_count(label_map: DataFrame, n: int) -> DataFrame:
    """Fail unless the label map has exactly ``n`` classes."""
    found = label_map.count()
    if found != n:
        raise ValueError(f"label map has {found} classes, {n} were configured")
    return label_map

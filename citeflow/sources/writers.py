"""Writers. Every sink writes in parallel, one folder per split where there are splits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from citeflow.schemas import METADATA, conform
from citeflow.sources.readers import CSV_OPTIONS


def _writer(df: DataFrame, mode: str):
    writer = df.write.mode(mode)
    return writer.partitionBy("split") if "split" in df.columns else writer


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet, or CSV as an export."""
    writer = _writer(df, mode)
    if fmt == "csv":
        options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
        writer.options(**options, lineSep="\n", emptyValue='""', nullValue="", quoteAll="false").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'csv'")


def write_chat(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object with ``messages`` per line."""
    keep = ["messages", "split"] if "split" in df.columns else ["messages"]
    _writer(df.select(*keep), mode).json(path)


def write_pairs(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object with ``question`` and ``answer`` per line."""
    keep = [c for c in ("pair_id", "question", "answer", "split") if c in df.columns]
    _writer(df.select(*keep), mode).option("ignoreNullFields", "false").json(path)


def write_label_map(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("passage_id", "token", "label_idx").write.mode(mode).parquet(path)


def append_cache(df: DataFrame, path: str, batch_id: int) -> None:
    """Keep one batch of metadata rows under its number; writing the same batch again replaces it."""
    conform(df, METADATA).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

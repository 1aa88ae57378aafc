"""Metadata: joined to contexts, shaped from lookup responses, and collected key by key."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.functions.names import field_or_name, first_nonempty, json_or, match_count, parse_name_list, split_judges
from citeflow.functions.text import strip_ws
from citeflow.operators.dedup import distinct_keys, remaining, union_all
from citeflow.operators.joins import hot_keys, join_on_slices
from citeflow.operators.numbering import HOT_ROWS
from citeflow.schemas import METADATA, conform, row_key

Lookup = Callable[[DataFrame], DataFrame]


def one_per_key(meta: DataFrame, on: str) -> DataFrame:
    """One metadata row per key: a successful one first, then the one with the smallest digest."""
    others = [c for c in meta.columns if c != on]
    failed = (F.coalesce(F.col("status"), F.lit("")) != "ok") if "status" in others else F.lit(False)
    order = F.struct(failed.alias("failed"), row_key(meta, others).alias("digest"))
    best = meta.groupBy(on).agg(F.min_by(F.struct(*others), order).alias("_best"))
    return best.select(on, "_best.*")


def judge_metadata(meta: DataFrame, on: str = "dest_cite") -> DataFrame:
    """One metadata row per citation with its names as an array: parsed here once, not again for every context."""
    single = one_per_key(meta, on)
    if "judge_names" not in single.columns or isinstance(single.schema["judge_names"].dataType, T.ArrayType):
        return single
    return single.withColumn("judge_names", parse_name_list(F.col("judge_names")))


def enrich(
    left: DataFrame,
    meta: DataFrame,
    on: str = "dest_cite",
    null_safe: bool = False,
    on_dup: str = "first",
    hot_rows: int = HOT_ROWS,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Left join with the metadata; every row of ``left`` stays.

    A key with several metadata rows gives one of them (``first``), all of them (``fanout``) or fails (``error``).
    ``null_safe`` lets missing keys match missing keys. ``keys_from`` is a cheaper frame to find hot keys in, one that
    has all rows of ``left`` and perhaps more.
    """
    if on_dup == "error":
        twice = meta.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).limit(5).collect()
        if twice:
            raise ValueError(f"several metadata rows for one key, for example {[r[on] for r in twice]}")
    elif on_dup == "first":
        meta = one_per_key(meta, on)
    elif on_dup != "fanout":
        raise ValueError("on_dup must be 'first', 'fanout' or 'error'")
    keys = left if keys_from is None else keys_from
    hot = hot_keys(keys if null_safe else keys.where(F.col(on).isNotNull()), on, hot_rows)
    return join_on_slices(left, meta, on, "left", hot, null_safe)


def _first_cluster(lookup: Column) -> Column:
    """Address of the first match's first cluster: a string, or an object with ``url`` or ``resource_uri``."""
    matches = F.from_json(lookup, "array<struct<clusters:array<string>>>")
    first = F.try_element_at(F.try_element_at(matches, F.lit(1))["clusters"], F.lit(1))
    as_object = first_nonempty(F.get_json_object(first, "$.url"), F.get_json_object(first, "$.resource_uri"))
    return F.when(first.startswith("{"), as_object).otherwise(F.nullif(first, F.lit("")))


def lookup_status(cite: Column, lookup: Column, cluster: Column, empty_is_not_found: bool = False) -> Column:
    """What became of one lookup."""
    is_object = F.json_object_keys(lookup).isNotNull()
    empty_list = F.json_array_length(lookup) == 0
    body_keys = F.array_size(F.json_object_keys(cluster))
    return (
        F.when(F.coalesce(cite, F.lit("")) == "", "error")
        .when(empty_list, "not_found" if empty_is_not_found else "timeout_error")
        .when(match_count(lookup) == 0, "timeout_error")
        .when(is_object | ~F.coalesce(F.get_json_object(lookup, "$[0]").startswith("{"), F.lit(False)), "processing_error")
        .when(_first_cluster(lookup).isNull(), "not_found")
        .when(F.json_array_length(cluster) > 0, "processing_error")
        .when(F.coalesce(body_keys, F.lit(0)) == 0, "cluster_timeout_error")
        .otherwise("ok")
    )


def parse_lookup(
    df: DataFrame,
    lookup_col: str = "lookup_json",
    cluster_col: str = "cluster_json",
    key: str = "dest_cite",
    empty_is_not_found: bool = False,
) -> DataFrame:
    """Metadata rows from landed responses; fields are filled only where the status is ``ok``."""
    cite, lookup, body = F.col(key), F.col(lookup_col), F.col(cluster_col)
    status = lookup_status(cite, lookup, body, empty_is_not_found)
    ok = F.col("status") == "ok"
    judge_list = F.from_json(body, "judges array<string>")["judges"]
    judges = F.when(judge_list.isNotNull(), F.filter(judge_list, lambda x: x != "")).otherwise(
        split_judges(F.get_json_object(body, "$.judges"))
    )
    none = F.array().cast("array<string>")
    fields = {
        "case_name": json_or(body, "case_name", "caseName"),
        "court": field_or_name(body, "court"),
        "date_filed": json_or(body, "date_filed", "dateFiled"),
        "cluster_id": json_or(body, "id", "pk").try_cast("bigint"),
        "author_judge": json_or(body, "author_str", "author"),
        "panel_text": json_or(body, "panel", "panel_str"),
    }
    shaped = df.withColumn("status", status).select(
        cite.alias("dest_cite"),
        "status",
        F.when(F.col("status") == "error", 0).otherwise(match_count(lookup)).alias("lookup_matches"),
        F.coalesce(F.when(ok, judges), none).alias("judge_names"),
        *[F.when(ok, c).alias(name) for name, c in fields.items()],
    )
    return conform(shaped, METADATA)


def landed(responses: DataFrame) -> Lookup:
    """A lookup that reads responses already landed as a table ``(dest_cite, lookup_json, cluster_json)``."""
    return lambda keys: keys.select("dest_cite").join(responses, "dest_cite", "left")


def lookup_with(df: DataFrame, fn: Callable[[list[str]], Iterable[tuple[str | None, str | None]]]) -> DataFrame:
    """Ask a user-given service, one Arrow batch of keys at a time, from the executors.

    ``fn`` gets the trimmed keys and returns ``(lookup_json, cluster_json)`` for each.
    """

    def ask(batches):
        import pandas as pd

        for batch in batches:
            answers = list(fn(list(batch["asked"])))
            yield pd.DataFrame(
                {
                    "dest_cite": batch["dest_cite"],
                    "lookup_json": [a[0] for a in answers],
                    "cluster_json": [a[1] for a in answers],
                }
            )

    asked = df.select("dest_cite", strip_ws(F.col("dest_cite")).alias("asked"))
    return asked.mapInPandas(ask, "dest_cite string, lookup_json string, cluster_json string")


def to_do(worklist: DataFrame, cache: DataFrame, retry_statuses: tuple[str, ...] = ()) -> DataFrame:
    """Keys without a final answer: never looked up, or looked up with a status that is to be tried again."""
    done = cache.where(~F.col("status").isin(*retry_statuses)) if retry_statuses else cache
    return remaining(distinct_keys(worklist, "dest_cite"), done, "dest_cite")


def enrich_incremental(
    worklist: DataFrame, lookup: Lookup, cache: DataFrame, retry_statuses: tuple[str, ...] = ()
) -> DataFrame:
    """The cache after looking up what is still missing; a repeated attempt replaces the older row of its key."""
    keys = to_do(worklist, cache, retry_statuses)
    new = parse_lookup(lookup(keys))
    kept = remaining(cache, keys, "dest_cite") if retry_statuses else cache
    return union_all(conform(kept, METADATA), new)


def latest_attempt(cache: DataFrame, order: str = "batch_id") -> DataFrame:
    """Newest row of each key from an append-only cache."""
    return cache.groupBy("dest_cite").agg(F.max_by(F.struct(*cache.columns), order).alias("_r")).select("_r.*")

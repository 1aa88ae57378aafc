"""Dataset builds end to end: contexts in, split and formatted rows out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeflow.functions.chat import conversation, prompt
from citeflow.functions.names import parse_name_list
from citeflow.functions.text import tag_format
from citeflow.operators.audit import assert_no_leakage
from citeflow.operators.dedup import dedup_project, union_all
from citeflow.operators.enrichment import enrich, judge_metadata
from citeflow.operators.joins import join_spread
from citeflow.operators.labels import build_label_map, encode_labels
from citeflow.operators.numbering import HOT_ROWS, count_groups
from citeflow.operators.sampling import group_quota, sample_per_group
from citeflow.operators.splitting import stratified_split
from citeflow.params import DatasetParams
from citeflow.session import materialise


@dataclass(frozen=True)
class Rows:
    """How to treat the rows of a build.

    ``key`` names a column that is unique per row, if the source has one; then no two rows are equal and looking for
    copies is left out. ``strict`` fails on passages too rare to split. ``hot_rows`` is the largest group one task takes.
    """

    key: str | None = None
    strict: bool = True
    hot_rows: int = HOT_ROWS


def prepare(contexts: DataFrame, cols: list[str], params: DatasetParams, rows: Rows = Rows(), metadata: DataFrame | None = None) -> DataFrame:
    """Distinct, sampled per passage, split and optionally enriched: ``row_id, cols.., split``.

    Sample and split use one numbering of each passage's rows, so the rows are shuffled once for both. Metadata has
    one row per key here and only adds columns, so it is joined last, to the sampled rows only.
    """
    wanted = [*cols, "dest_cite"] if metadata is not None and "dest_cite" not in cols else list(cols)
    if rows.key:
        unique = contexts.select(F.col(rows.key).alias("row_id"), *wanted)
    else:
        unique = materialise(dedup_project(contexts, wanted, row_id="row_id"))
    unique = unique.where(F.col("passage_id").isNotNull())
    counts = materialise(count_groups(unique, ["passage_id"]))
    kept = counts.select("passage_id", group_quota(F.col("_n"), params.fraction).alias("_n")).where(F.col("_n") > 0)
    sampled = sample_per_group(unique, "passage_id", params.fraction, params.seed, hot_rows=rows.hot_rows, counts=counts)
    split = stratified_split(
        sampled, "passage_id", params.ratios, params.seed, rows.strict, hot_rows=rows.hot_rows, counts=kept
    )
    if metadata is not None:
        single = judge_metadata(metadata)
        split = enrich(split, single, "dest_cite", on_dup="fanout", hot_rows=rows.hot_rows, keys_from=unique)
        split = split if "dest_cite" in cols else split.drop("dest_cite")
    return split


def judges_of(df: DataFrame, col: str = "judge_names") -> Column:
    """Judge names as an array, from an array or from its printed form."""
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.coalesce(F.col(col), F.array().cast("array<string>"))
    return parse_name_list(F.col(col))


def judges_text(judges: Column, context: Column) -> Column:
    return tag_format([("JUDGES", F.array_join(judges, ", ")), ("DEST CONTEXT", context)])


def courts_text(context: Column, dest_court: Column, source_court: Column | None = None, source_date: Column | None = None) -> Column:
    """Text with court tags; the source fields tell about the right passage and are for audits only."""
    fields = [("DEST COURT", dest_court)]
    if source_court is not None:
        fields.append(("SOURCE COURT", source_court))
    if source_date is not None:
        fields.append(("SOURCE DATE", source_date))
    return tag_format([*fields, ("DEST CONTEXT", context)])


def query_text(context: Column, dest_court: Column | None = None) -> Column:
    return context if dest_court is None else tag_format([("DEST COURT", dest_court), ("CONTEXT", context)])


def paragraph_text(passage: Column, source_court: Column | None = None, source_date: Column | None = None) -> Column:
    if source_court is None or source_date is None:
        return passage
    return tag_format([("SOURCE COURT", source_court), ("SOURCE DATE", source_date), ("PARAGRAPH", passage)])


def train_label_map(split: DataFrame) -> DataFrame:
    return build_label_map(split.where(F.col("split") == "train"))


def chat_dataset(split: DataFrame, label_map: DataFrame, enriched: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One conversation per context, answered by the passage's token: ``row_id, split, passage_id, messages``."""
    context = F.col("destination_context")
    payload = judges_text(judges_of(split), context) if enriched else tag_format([("preceding_context", context)])
    asked = assert_no_leakage(split).select("row_id", "split", "passage_id", prompt(payload, enriched).alias("_user"))
    answered = encode_labels(asked, label_map, hot_rows=hot_rows)
    return answered.select("row_id", "split", "passage_id", conversation(F.col("_user"), F.col("token")).alias("messages"))


def classifier_dataset(split: DataFrame, fields: list[tuple[str, str]] | None = None) -> DataFrame:
    """Text and class per context: the bare context, or the given (tag, column) fields around it. A list of names
    becomes one text."""
    assert_no_leakage(split)
    context = F.col("destination_context")
    if not fields:
        return split.select("row_id", "split", "passage_id", context.alias("destination_context"))

    def shown(c: str) -> Column:
        return F.array_join(c, ", ") if isinstance(split.schema[c].dataType, T.ArrayType) else F.col(c)

    text = tag_format([*[(tag, shown(c)) for tag, c in fields], ("DEST CONTEXT", context)])
    return split.select("row_id", "split", "passage_id", text.alias("input_text"))


def known_passages(passages: DataFrame, label_map: DataFrame) -> DataFrame:
    """Passages that belong to the label space."""
    return passages.join(label_map.select("passage_id"), "passage_id", "left_semi")


def attach_passage(contexts: DataFrame, passages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the text of each row's passage; null where the dictionary lacks it."""
    return join_spread(contexts, passages, "passage_id", "left", hot_rows=hot_rows)


def missing_passages(attached: DataFrame) -> DataFrame:
    """How many rows of each passage id have no text."""
    return attached.where(F.col("passage").isNull()).groupBy("passage_id").agg(F.count("*").alias("n_rows"))


def pair_dataset(
    split: DataFrame, passages: DataFrame, court: str | None = None, hot_rows: int = HOT_ROWS, source_fields: bool = False
) -> DataFrame:
    """Question and answer per context; rows whose passage has no text are left out (see ``missing_passages``).

    ``source_fields`` puts source court and date around the answers. They tell where the right passage comes from, so
    this is only for repeating older experiments; without it such columns are refused.
    """
    if not source_fields:
        assert_no_leakage(split)
    attached = attach_passage(split, passages, hot_rows).where(F.col("passage").isNotNull())
    question = query_text(F.col("destination_context"), F.col(court) if court else None)
    source = (F.col("source_court"), F.col("source_date")) if source_fields else ()
    answer = paragraph_text(F.col("passage"), *source)
    return attached.select(F.col("row_id").alias("pair_id"), "split", question.alias("question"), answer.alias("answer"))


def citation_worklist(contexts: DataFrame, params: DatasetParams, rows: Rows = Rows()) -> DataFrame:
    """Train rows with their citation: what the metadata collection starts from."""
    split = prepare(contexts, ["passage_id", "destination_context", "dest_cite"], params, rows)
    return split.where(F.col("split") == "train").drop("split")


def build_chat(contexts: DataFrame, params: DatasetParams, metadata: list[DataFrame] | None = None, rows: Rows = Rows()) -> DataFrame:
    """The chat data from raw contexts, with judges from the metadata files when ``params.enriched``."""
    meta = union_all(*metadata) if params.enriched and metadata else None
    split = materialise(prepare(contexts, ["passage_id", "destination_context"], params, rows, meta))
    return chat_dataset(split, train_label_map(split), params.enriched, rows.hot_rows)

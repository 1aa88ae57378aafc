"""A corpus pipeline of the operators in ``citeflow.llm``; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm import jaccard, langid, packing, secrets, toxic
from citeflow.llm.frames import col, free_name, give_back, label_share, read, stored
from citeflow.llm.queries import BYTE_BPE

#: A document is rejected as toxic from this chance on, and for its language below this one.
TOXIC, LANGUAGE = 0.5, 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain scores as toxic go; null and empty texts stay."""
    model = toxic.train(docs.where(label_share("doc_id") != 0), read(spark, sf_dir, "labels"))
    give_back()  # what the driver held to train
    name = free_name(docs, "_toxicity")
    scored = docs.withColumn(name, toxic.tag(F.col("text"), model)["score"])
    return scored.where(F.col(name) < TOXIC).select(*[col(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the languages, go. Where no row names a language, all stay."""
    model = langid.train(docs.where(label_share("doc_id") != 0))
    give_back()
    if not model.languages:
        return docs
    name = free_name(docs, "_language")
    found = docs.withColumn(name, langid.identify(F.col("text"), model))
    clear = (F.col(f"{name}.lang") != langid.UNKNOWN) & (F.col(f"{name}.score") >= LANGUAGE)
    return found.where(clear).select(*[col(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    give_back()  # the models of the stages before
    return jaccard.keep_one_of_each_class(docs, n=5, num=80, den=100)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets and the character count follows; all documents stay."""
    redacted = secrets.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return redacted
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return redacted.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: a row per piece of a document with its place."""
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the models nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

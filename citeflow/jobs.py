"""The pipeline's steps as jobs: ``spark-submit citeflow/jobs.py <job> --help`` or ``python -m citeflow.jobs <job>``.

Each job reads tables or files, runs one plan and writes one output named by the dataset tag.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.functions.text import CONTEXT_LAYOUT, TASK_COURT, TASK_COURT_DATE, TASK_PLAIN, e5_query, with_instruction
from citeflow.operators import audit, labels
from citeflow.operators.dedup import uncovered
from citeflow.operators.enrichment import landed, latest_attempt
from citeflow.operators.metrics import ir_metrics, topk_accuracy
from citeflow.operators.retrieval import retrieval_ranks, retrieval_report
from citeflow.operators.sampling import first_n, sample_n
from citeflow.params import DatasetParams, SplitRatios, dataset_tag
from citeflow.plans import datasets, evaluation
from citeflow.schemas import METADATA
from citeflow.session import materialise
from citeflow.sources import readers, writers
from citeflow.streaming.enrichment import read_enriched, start_enrichment


def _params(args) -> DatasetParams:
    shares = dict(zip(("train", "valid", "test"), map(float, args.ratios.split("/"))))
    return DatasetParams(args.corpus, args.fraction, SplitRatios.of(shares), args.seed, args.enriched)


def _rows(args) -> datasets.Rows:
    return datasets.Rows(key=args.key, strict=not args.lenient)


def _contexts(spark: SparkSession, args) -> DataFrame:
    if args.contexts.endswith((".csv", ".csv.gz")):
        return readers.read_contexts(spark, args.contexts, partitions=args.partitions)
    return spark.read.parquet(args.contexts)


def _profile(split: DataFrame) -> None:
    audit.split_counts(split).show()
    audit.distinct_count(split, "passage_id").show()


def finetuning_data(spark: SparkSession, args) -> None:
    """Contexts (and metadata files) to chat data and the label map."""
    params, rows = _params(args), _rows(args)
    meta = readers.read_metadata(spark, args.metadata) if params.enriched and args.metadata else None
    if params.enriched and meta is None:
        raise SystemExit("--enriched needs --metadata")
    split = materialise(datasets.prepare(_contexts(spark, args), ["passage_id", "destination_context"], params, rows, meta))
    _profile(split)
    if params.enriched:
        audit.coverage(split.withColumn("judge_names", datasets.judges_of(split)), ["judge_names"]).show()
    label_map = datasets.train_label_map(split)
    writers.write_label_map(label_map, f"{args.out}/label_map/{dataset_tag(params)}")
    writers.write_chat(datasets.chat_dataset(split, label_map, params.enriched), f"{args.out}/chat/{dataset_tag(params)}")


def classifier_data(spark: SparkSession, args) -> None:
    """Contexts to classifier files, with the deciding court around the text when enriched."""
    params, rows = _params(args), _rows(args)
    cols = ["passage_id", "destination_context", *(["dest_court"] if params.enriched else [])]
    split = datasets.prepare(_contexts(spark, args), cols, params, rows)
    made = datasets.classifier_dataset(split, [("DEST COURT", "dest_court")] if params.enriched else None)
    writers.write_splits(made.drop("row_id"), f"{args.out}/classifier/{dataset_tag(params)}", args.format)


def pair_data(spark: SparkSession, args) -> None:
    """Contexts and passages to question-answer pairs, for the passages of one label map."""
    params, rows = _params(args), _rows(args)
    label_map = readers.read_label_map(spark, args.label_map)
    known = datasets.known_passages(readers.read_passages(spark, args.passages), label_map)
    cols = ["passage_id", "destination_context", *(["dest_court"] if params.enriched else [])]
    cols += ["source_court", "source_date"] if args.source_fields else []
    split = materialise(datasets.prepare(_contexts(spark, args), cols, params, rows))  # the join below reads it twice
    made = datasets.pair_dataset(split, known, "dest_court" if params.enriched else None, source_fields=args.source_fields)
    if args.instruction:
        enriched = TASK_COURT if args.instruction == "query" else TASK_COURT_DATE
        task = enriched if params.enriched else TASK_PLAIN
        question = F.col("question")
        made = made.withColumn(
            "question",
            e5_query(question, task) if args.instruction == "query" else with_instruction(question, CONTEXT_LAYOUT.format(task=task), args.end_marker),
        )
    writers.write_pairs(made.drop("pair_id"), f"{args.out}/pairs/{dataset_tag(params)}")


def citation_worklist(spark: SparkSession, args) -> None:
    """Train rows with their citations."""
    params = _params(args)
    made = datasets.citation_worklist(_contexts(spark, args), params, _rows(args))
    writers.write_splits(made.drop("row_id"), f"{args.out}/worklist/{dataset_tag(params)}", args.format)


def collect_metadata(spark: SparkSession, args) -> None:
    """Arrived citations to the metadata cache, from landed responses; only what is new is looked up."""
    responses = spark.read.schema("dest_cite string, lookup_json string, cluster_json string").parquet(args.responses)
    arriving = spark.readStream.schema("dest_cite string").parquet(args.worklist)
    retry = tuple(s for s in args.retry.split(",") if s)
    start_enrichment(arriving, landed(responses), f"{args.out}/cache", f"{args.out}/progress", retry).awaitTermination()
    final = latest_attempt(read_enriched(spark, f"{args.out}/cache")).select(*METADATA.names)
    audit.status_counts(final).show()
    final.write.mode("overwrite").parquet(f"{args.out}/metadata")


def evaluate_vectors(spark: SparkSession, args) -> None:
    """Pairs with vectors (``pair_id, question_vec, answer_vec``) to top-k accuracy and ranking metrics."""
    pairs = spark.read.parquet(args.pairs)
    queries = pairs.select(F.col("pair_id").alias("query_id"), F.col("question_vec").alias("vec"))
    corpus = pairs.select(F.col("pair_id").alias("cand_id"), F.col("answer_vec").alias("vec"))
    truth = pairs.select(F.col("pair_id").alias("query_id"), F.col("pair_id").alias("truth_id"))
    if args.samples:
        queries = sample_n(queries, args.samples, args.seed, "query_id")
    ranks = materialise(retrieval_ranks(queries, corpus, truth))  # one scan for both kinds of metrics
    topk_accuracy(ranks).write.mode("overwrite").json(f"{args.out}/accuracy")
    ir_metrics(ranks).write.mode("overwrite").json(f"{args.out}/ir_metrics")


def evaluate_scores(spark: SparkSession, args) -> None:
    """Scores of any model (``query_id, cand_id, score``) and the truth (``query_id, truth_id``) to top-k accuracy."""
    truth = spark.read.parquet(args.truth)
    if args.samples:
        truth = sample_n(truth, args.samples, args.seed, "query_id")
    made = evaluation.evaluate_scores(spark.read.parquet(args.scores), truth)
    made.write.mode("overwrite").json(f"{args.out}/accuracy")


def uncovered_citations(spark: SparkSession, args) -> None:
    """Citations of the (test) contexts that the metadata files lack, optionally the first of them only."""
    wanted = uncovered(_contexts(spark, args), readers.read_metadata(spark, args.metadata), "dest_cite")
    wanted = first_n(wanted, args.first, "dest_cite") if args.first else wanted
    wanted.write.mode("overwrite").parquet(f"{args.out}/uncovered")


def retrieval_examples(spark: SparkSession, args) -> None:
    """Some pairs with vectors and texts (``pair_id, question, answer, question_vec, answer_vec``) to a report of what
    is found for each question."""
    pairs = spark.read.parquet(args.pairs)
    queries = pairs.select(F.col("pair_id").alias("query_id"), F.col("question_vec").alias("vec"), F.col("question").alias("text"))
    corpus = pairs.select(F.col("pair_id").alias("cand_id"), F.col("answer_vec").alias("vec"), F.col("answer").alias("text"))
    truth = pairs.select(F.col("pair_id").alias("query_id"), F.col("pair_id").alias("truth_id"))
    asked = materialise(sample_n(queries, args.samples, args.seed, "query_id"))
    retrieval_report(asked, corpus, truth).write.mode("overwrite").json(f"{args.out}/examples")


def check_labels(spark: SparkSession, args) -> None:
    """Fail unless the label map has the configured number of classes."""
    labels.check_label_count(readers.read_label_map(spark, args.label_map), args.classes)


BUILDS = (finetuning_data, classifier_data, pair_data, citation_worklist)


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(description=__doc__)
    jobs = main.add_subparsers(dest="job", required=True)

    def add(fn, **options):
        sub = jobs.add_parser(fn.__name__.replace("_", "-"), help=fn.__doc__)
        sub.set_defaults(run=fn)
        for name, spec in options.items():
            sub.add_argument(f"--{name.replace('_', '-')}", **spec)
        return sub

    needed = {"required": True}
    for fn in BUILDS:
        sub = add(fn, contexts=needed, out=needed, corpus={"default": "10"}, fraction={"type": float, "default": 0.2})
        sub.add_argument("--ratios", default="0.8/0.1/0.1", help="train/valid/test")
        sub.add_argument("--seed", type=int, default=42)
        sub.add_argument("--enriched", action="store_true")
        sub.add_argument("--key", help="column that is unique per row, if the source has one")
        sub.add_argument("--lenient", action="store_true", help="passages of one row go to train instead of failing")
        sub.add_argument("--partitions", type=int, help="spread files that cannot be split")
        sub.add_argument("--format", choices=("parquet", "csv"), default="parquet")
        if fn is finetuning_data:
            sub.add_argument("--metadata", nargs="*", default=[])
        if fn is pair_data:
            sub.add_argument("--passages", required=True)
            sub.add_argument("--label-map", required=True)
            sub.add_argument("--instruction", choices=("query", "context"))
            sub.add_argument("--end-marker", default="")
            sub.add_argument("--source-fields", action="store_true", help="source court and date in the answers (leaks)")
    add(collect_metadata, worklist=needed, responses=needed, out=needed, retry={"default": ""})
    sample = {"samples": {"type": int, "help": "evaluate this many queries only"}, "seed": {"type": int, "default": 42}}
    add(evaluate_vectors, pairs=needed, out=needed, **sample)
    add(evaluate_scores, scores=needed, truth=needed, out=needed, **sample)
    citations = {"metadata": {"nargs": "+", "required": True}, "first": {"type": int}, "partitions": {"type": int}}
    add(uncovered_citations, contexts=needed, out=needed, **citations)
    add(retrieval_examples, pairs=needed, out=needed, samples={"type": int, "default": 5}, seed={"type": int, "default": 42})
    add(check_labels, label_map=needed, classes={"type": int, "required": True})
    return main


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName(f"citeflow {args.job}").getOrCreate(), args)


if __name__ == "__main__":
    main()

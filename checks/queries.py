"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import tables as t
from citeflow.functions import (
    conversation,
    dot,
    keep_last_words,
    l2_normalise,
    parse_name_list,
    preview,
    prompt,
    render_chat,
    strip_ws,
    tag_format,
    with_instruction,
    word_count,
)
from citeflow.functions.text import CONTEXT_LAYOUT, TASK_COURT, TASK_COURT_DATE, TASK_PLAIN, e5_query
from citeflow.operators import audit, bayes, clusters, dedup, embedding, enrichment, labels, ledger, metrics, ranking, retrieval, sampling, splitting, units
from citeflow.params import DatasetParams, SplitRatios
from citeflow.plans import datasets, evaluation
from citeflow.schemas import METADATA, conform
from citeflow.session import materialise, scratch_dir, stored
from citeflow.sources import compaction, layout, readers, writers
from citeflow.streaming.enrichment import CACHE, read_enriched, start_enrichment

SEED = 42
BATCH = 16
EMBED_DIM = 16
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r(c: str, digits: int = 6):
    return F.round(F.col(c).cast("double"), digits).alias(c)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_r(f.name, digits) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


# ---- retrieval -------------------------------------------------------------------------------------------------


def _pairs(spark, sf):
    return t.pair_queries(spark, sf), t.pair_corpus(spark, sf), t.pair_truth(spark, sf)


@query
def topk_accuracy_pairs(spark, sf):
    return _rounded(evaluation.evaluate_vectors(*_pairs(spark, sf)))


@query
def retrieval_ranks(spark, sf):
    return retrieval.retrieval_ranks(*_pairs(spark, sf), block_rows=100)


@query
def ir_metrics_pairs(spark, sf):
    return _rounded(evaluation.evaluate_ir(*_pairs(spark, sf)))


@query
def top10_neighbours(spark, sf):
    q, c, _ = _pairs(spark, sf)
    return retrieval.blocked_topk(q, c, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query
def top10_neighbours_blocked(spark, sf):
    q, c, _ = _pairs(spark, sf)
    return retrieval.blocked_topk(q, c, 10, block_rows=64).withColumn("rank", F.col("rank").cast("bigint"))


@query
def clustered_neighbours(spark, sf):
    """The clustered index with every cluster visited: all rows are in it, and the answer is the exact one."""
    q, c, _ = _pairs(spark, sf)
    index = clusters.build_index(c, SEED, slice_rows=40)
    found = clusters.search_index(index, q, 10, len(index.centres), block_rows=128)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query
def clustered_recall(spark, sf):
    """As few clusters as recall 0.9 takes on a sample; the recall of all queries against the exact neighbours."""
    q, c, _ = _pairs(spark, sf)
    found, _ = clusters.approximate_topk(q, c, 10, target=0.95)
    exact = retrieval.blocked_topk(q, c, 10)
    hits = exact.join(found.select("query_id", "cand_id", F.lit(1).alias("hit")), ["query_id", "cand_id"], "left")
    return hits.agg(F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


@query
def pair_similarity(spark, sf):
    """Normalised dot product of each pair."""
    q, c, _ = _pairs(spark, sf)
    both = q.join(c.withColumnRenamed("vec", "other"), F.col("query_id") == F.col("cand_id"))
    return both.select(F.col("query_id").alias("pair_id"), F.round(dot(l2_normalise(F.col("vec")), l2_normalise(F.col("other"))), 6).alias("score"))


@query
def retrieval_report(spark, sf):
    texts = t.table(spark, sf, "documents").select(F.col("doc_id").alias("_id"), "text")
    q, c, truth = _pairs(spark, sf)
    chosen = sampling.sample_n(q, 5, SEED, "query_id")
    asked = chosen.join(texts, F.col("query_id") == F.col("_id"), "left").drop("_id")
    corpus = c.join(texts, F.col("cand_id") == F.col("_id"), "left").drop("_id")
    return retrieval.retrieval_report(asked, corpus, truth)


@query
def class_softmax_topk(spark, sf):
    top = retrieval.blocked_softmax(t.class_queries(spark, sf).drop("truth"), t.class_means(spark, sf), 5)
    return _rounded(top.withColumn("rank", F.col("rank").cast("bigint")))


@query
def argmax_rows(spark, sf):
    lines = t.table(spark, sf, "lineitem")
    scores = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("cand_id"), F.col("l_quantity").alias("score"))
    return ranking.argmax_per_group(scores.groupBy("query_id", "cand_id").agg(F.max("score").alias("score")))


@query
def retrieval_ranks_ties(spark, sf):
    """Every vector three times in the corpus, the second copy is right: unrounded scores, ties by id."""
    vectors = t.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    corpus = vectors.select("vec", F.explode(F.array(*[F.col("vec_id") * 3 + k for k in range(3)])).alias("cand_id"))
    truth = vectors.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") * 3 + 1).alias("truth_id"))
    return retrieval.retrieval_ranks(vectors.withColumnRenamed("vec_id", "query_id"), corpus, truth, digits=None)


@query
def class_argmax(spark, sf):
    asked = t.class_queries(spark, sf)
    best = retrieval.blocked_topk(asked.select("query_id", "vec"), t.class_means(spark, sf), 1)
    return best.join(asked.select("query_id", "truth"), "query_id").select("query_id", F.col("cand_id").alias("pred"), "truth")


@query
def class_accuracy(spark, sf):
    return _rounded(metrics.accuracy(class_argmax(spark, sf)))


# ---- distinct rows, overlap ------------------------------------------------------------------------------------


@query
def dedup_project(spark, sf):
    return dedup.dedup_project(t.contexts_dup(spark, sf), ["passage_id", "destination_context", "dest_cite"])


@query
def dedup_exact(spark, sf):
    """Rows that differ by a microsecond stay two, rows that differ by the sign of zero are one."""
    rows = t.table(spark, sf, "events").select(t.tagged("cite_", F.col("user_id")).alias("dest_cite"), "ts")
    later = rows.withColumn("ts", F.col("ts") + F.expr("interval 1 microsecond")).withColumn("value", F.lit(0.0))
    rows = dedup.union_all(rows.withColumn("value", F.lit(0.0)), rows.withColumn("value", -F.lit(0.0)), later)
    return dedup.dedup_project(rows, ["dest_cite"]).groupBy("dest_cite").agg(F.count("*").alias("n_rows"))


@query
def no_leakage(spark, sf):
    """Source columns are refused; without them the frame passes as it is."""
    rows = t.contexts(spark, sf)
    try:
        audit.assert_no_leakage(rows)
    except ValueError:
        return audit.assert_no_leakage(rows.drop("source_court", "source_date")).drop("destination_context")
    raise AssertionError("source columns passed")


@query
def name_lists(spark, sf):
    """Judge names in the printed forms that are no plain JSON list."""
    rows = t.table(spark, sf, "customer").join(t.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    forms = ["'{c}', '{n}'", "['{c}', None]", "['{c}' '{n}']", "('{c}',)", "['\\x41{c}', True]"]
    raw = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        made = F.replace(F.replace(F.lit(form), F.lit("{c}"), F.col("c_name")), F.lit("{n}"), F.col("n_name"))
        raw = F.when(F.col("c_custkey") % len(forms) == k, made).otherwise(raw)
    return rows.select("c_custkey", F.array_join(parse_name_list(raw), "|").alias("names"))


@query
def distinct_keys(spark, sf):
    return dedup.distinct_keys(t.arriving(spark, sf), "dest_cite", "event_id")


@query
def split_overlap(spark, sf):
    split = splitting.stratified_split(t.contexts(spark, sf), "passage_id", seed=SEED)
    found = audit.split_overlap(split, ["destination_context"])
    return found.groupBy("splits").agg(F.count("*").alias("n_texts"), F.sum("n_rows").alias("n_rows"))


# ---- samples, splits, batches ----------------------------------------------------------------------------------


@query
def sample_per_group(spark, sf):
    return sampling.sample_per_group(t.contexts_wide(spark, sf), "passage_id", 0.2, SEED)


@query
def sample_per_group_all(spark, sf):
    """Every group keeps at least one row; hot groups are numbered in slices."""
    return sampling.sample_per_group(t.contexts_wide(spark, sf), "passage_id", 0.01, SEED, min_per_group=1, hot_rows=20)


@query
def sample_n(spark, sf):
    return sampling.sample_n(t.contexts_wide(spark, sf), 1000, SEED)


@query
def sample_large(spark, sf):
    """More rows than a single sort is used for."""
    return sampling.sample_n(t.contexts_wide(spark, sf), 15_000, SEED)


@query
def first_large(spark, sf):
    return sampling.first_n(t.contexts_wide(spark, sf), 12_000, "row_id")


@query
def shuffle_export(spark, sf):
    return sampling.shuffle_rows(t.contexts_wide(spark, sf), SEED)


@query
def first_n(spark, sf):
    return sampling.first_n(t.arriving(spark, sf), 500, "event_id").select("event_id", "dest_cite")


@query
def shuffle_rows(spark, sf):
    """Each row with its position in the shuffled order."""
    from citeflow.operators.numbering import number_all

    return number_all(t.contexts_wide(spark, sf), SEED, number="position").select("row_id", "position")


def _split(spark, sf):
    return splitting.stratified_split(t.contexts_wide(spark, sf), "passage_id", seed=SEED, strict=False)


@query
def stratified_split(spark, sf):
    return _split(spark, sf).select("row_id", "passage_id", "split")


@query
def stratified_split_uneven(spark, sf):
    """Strata of one court-like key in 70/10/20, numbered in slices."""
    rows = t.contexts(spark, sf)
    split = splitting.stratified_split(rows, "dest_court", SplitRatios(0.7, 0.1, 0.2), SEED, hot_rows=50)
    return split.select("row_id", "dest_court", "split")


@query
def split_counts(spark, sf):
    return audit.split_counts(_split(spark, sf))


@query
def distinct_per_split(spark, sf):
    return audit.distinct_count(_split(spark, sf), "passage_id")


@query
def value_share(spark, sf):
    shares = audit.value_share(_split(spark, sf), "passage_id", 5)
    return _rounded(shares.withColumn("rank", F.col("rank").cast("bigint")))


@query
def batches(spark, sf):
    rows = t.contexts(spark, sf).select("row_id", "passage_id")
    return sampling.assign_batches(rows, "passage_id", BATCH, SEED)


@query
def batch_repeats(spark, sf):
    """Questions that a batch holds twice although its answers are distinct."""
    rows = t.passage_refs(spark, sf)
    made = sampling.assign_batches(rows, "passage_id", 64, SEED).withColumn("question", F.md5("destination_context"))
    return audit.batch_repeats(made, "question")


# ---- labels ----------------------------------------------------------------------------------------------------


@query
def label_map(spark, sf):
    return _bigint(labels.build_label_map(t.contexts_wide(spark, sf)), "label_idx")


def _bigint(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


@query
def encode_labels(spark, sf):
    rows = t.contexts_wide(spark, sf)
    return _bigint(labels.encode_labels(rows, labels.build_label_map(rows)).drop("dest_cite"), "label_idx")


@query
def encode_labels_known(spark, sf):
    """Rows whose passage has no label are left out."""
    known = labels.build_label_map(t.passages(spark, sf))
    return _bigint(labels.encode_labels(t.passage_refs(spark, sf), known, "drop").drop("destination_context"), "label_idx")


@query
def unknown_labels(spark, sf):
    known = labels.build_label_map(t.passages(spark, sf))
    return labels.unknown_labels(t.passage_refs(spark, sf), known)


@query
def check_labels(spark, sf):
    """The map has as many classes as there are passages, and reads back from index to id."""
    rows = t.contexts_wide(spark, sf)
    made = labels.build_label_map(rows)
    labels.check_label_count(made, rows.select("passage_id").distinct().count())
    predicted = labels.encode_labels(rows, made).select("row_id", "label_idx")
    return _bigint(labels.decode_labels(predicted, made), "label_idx")


# ---- passages --------------------------------------------------------------------------------------------------


@query
def known_passages(spark, sf):
    used = labels.build_label_map(t.passage_refs(spark, sf))
    return datasets.known_passages(t.passages(spark, sf), used)


@query
def attach_passage(spark, sf):
    return datasets.attach_passage(t.passage_refs(spark, sf), t.passages(spark, sf)).drop("destination_context")


@query
def missing_passages(spark, sf):
    return datasets.missing_passages(datasets.attach_passage(t.passage_refs(spark, sf), t.passages(spark, sf)))


# ---- metadata --------------------------------------------------------------------------------------------------


def _meta(spark, sf):
    return dedup.union_all(t.metadata_a(spark, sf), t.metadata_b(spark, sf))


def _flat_judges(df):
    return df.withColumn("judge_names", F.array_join(parse_name_list(F.col("judge_names")), ", "))


@query
def enrich_first(spark, sf):
    joined = enrichment.enrich(t.contexts_wide(spark, sf), enrichment.judge_metadata(_meta(spark, sf)), on_dup="fanout")
    return joined.withColumn("judge_names", F.coalesce(F.array_join("judge_names", ", "), F.lit("")))


@query
def enrich_default(spark, sf):
    """One metadata row per key by default, missing keys matching missing ones."""
    return _flat_judges(enrichment.enrich(t.contexts_wide(spark, sf), _meta(spark, sf), null_safe=True))


@query
def enrich_fanout(spark, sf):
    return _flat_judges(enrichment.enrich(t.contexts_wide(spark, sf), _meta(spark, sf), on_dup="fanout", hot_rows=5))


@query
def coverage(spark, sf):
    rows = t.contexts_wide(spark, sf)
    joined = enrichment.enrich(_split(spark, sf), enrichment.judge_metadata(_meta(spark, sf)), on_dup="fanout", keys_from=rows)
    return _rounded(audit.coverage(joined, ["dest_cite", "judge_names"]))


@query
def uncovered(spark, sf):
    """Citations of the test rows that no metadata file has."""
    test = _split(spark, sf).where(F.col("split") == "test")
    return dedup.uncovered(test, _meta(spark, sf), "dest_cite")


def _flat(metadata: DataFrame) -> DataFrame:
    return _bigint(metadata.withColumn("judge_names", F.array_join("judge_names", ", ")), "lookup_matches")


@query
def parse_lookup(spark, sf):
    return _flat(enrichment.parse_lookup(t.responses(spark, sf)))


@query
def status_counts(spark, sf):
    return audit.status_counts(enrichment.parse_lookup(t.responses(spark, sf)))


def _cache(spark, sf):
    """What an earlier run has collected: the customers of the building trade."""
    trade = t.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
    keys = trade.select(t.tagged("cite_", F.col("c_custkey")).alias("dest_cite"))
    return enrichment.parse_lookup(enrichment.landed(t.responses(spark, sf))(keys))


@query
def progress(spark, sf):
    return audit.progress(t.arriving(spark, sf), _cache(spark, sf))


@query
def remaining(spark, sf):
    return dedup.remaining(dedup.distinct_keys(t.arriving(spark, sf), "dest_cite"), _cache(spark, sf), "dest_cite")


@query
def enrich_incremental(spark, sf):
    return _flat(enrichment.enrich_incremental(t.arriving(spark, sf), enrichment.landed(t.responses(spark, sf)), _cache(spark, sf)))


@query
def enrich_incremental_retry(spark, sf):
    """Cached timeouts are tried again against a service that now answers everything the same way."""
    cache = _cache(spark, sf)
    answered = t.responses(spark, sf).withColumn("lookup_json", F.lit('[{"clusters":[]}]'))
    return _flat(enrichment.enrich_incremental(t.arriving(spark, sf), enrichment.landed(answered), cache, ("timeout_error",)))


@query
def latest_attempt(spark, sf):
    """An append-only cache with a second attempt for every timeout."""
    first = enrichment.parse_lookup(t.responses(spark, sf)).withColumn("batch_id", F.lit(0))
    again = first.where("status = 'timeout_error'").withColumns({"status": F.lit("not_found"), "batch_id": F.lit(1)})
    return _flat(enrichment.latest_attempt(dedup.union_all(first, again)).drop("batch_id"))


@query
def compacted_cache(spark, sf):
    """The newest attempts from a snapshot and a later batch, in which every timeout was tried again."""
    folder = scratch_dir(spark, "cache")
    first = enrichment.parse_lookup(t.responses(spark, sf))
    writers.append_cache(first.where("status <> 'timeout_error'"), folder, 0)
    writers.append_cache(first.where("status = 'timeout_error'"), folder, 1)
    compaction.compact_cache(spark, folder, 0, CACHE)
    compaction.compact_cache(spark, folder, 1, CACHE)
    writers.append_cache(first.where("status = 'timeout_error'").withColumn("status", F.lit("not_found")), folder, 2)
    return _flat(compaction.read_newest(spark, folder, CACHE).drop("batch_id"))


@query
def conform_metadata(spark, sf):
    """Columns a source lacks become null."""
    made = _meta(spark, sf).withColumn("judge_names", parse_name_list(F.col("judge_names")))
    return _flat(conform(made, METADATA)).select("dest_cite", "judge_names", "case_name", "opinion_id", "status", "lookup_matches")


@query
def lookup_udf(spark, sf):
    """The service called from the executors, one batch of keys at a time."""

    def service(keys):
        for key in keys:
            n = int(key.split("_")[1])
            yield ('[{"clusters":["u/%d"]}]' % n, '{"id":%d,"case_name":"case %d"}' % (n + 1, n)) if n % 3 else ("[]", None)

    keys = dedup.distinct_keys(t.arriving(spark, sf), "dest_cite")
    return _flat(enrichment.parse_lookup(enrichment.lookup_with(keys, service)))


@query
def streaming_enrichment(spark, sf):
    """Arriving citations as a file stream into the cache; run twice, the second run finds nothing new."""
    schema = t.table(spark, sf, "events").schema
    folder = scratch_dir(spark, "streaming")
    for _ in range(2):
        events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        cites = events.select(t.tagged("cite_", F.col("user_id")).alias("dest_cite"))
        start_enrichment(cites, enrichment.landed(t.responses(spark, sf)), f"{folder}/cache", f"{folder}/progress").awaitTermination()
    return _flat(read_enriched(spark, f"{folder}/cache").drop("batch_id"))


# ---- texts -----------------------------------------------------------------------------------------------------


@query
def tagged_text(spark, sf):
    rows = t.contexts(spark, sf)
    context = F.col("destination_context")
    judges = F.filter(F.array(F.col("dest_court"), F.when(F.col("row_id") % 2 == 0, F.col("source_court"))), lambda x: x.isNotNull())
    return rows.select(
        "row_id",
        datasets.judges_text(judges, context).alias("judges_text"),
        datasets.courts_text(context, F.col("dest_court")).alias("court_text"),
        datasets.courts_text(context, F.col("dest_court"), F.col("source_court"), F.col("source_date")).alias("all_courts_text"),
        tag_format([("preceding_context", context)]).alias("plain_payload"),
        datasets.query_text(context, F.col("dest_court")).alias("query_text"),
        datasets.paragraph_text(context, F.col("source_court"), F.col("source_date")).alias("paragraph_text"),
        preview(context, 200).alias("preview"),
    )


@query
def prompts(spark, sf):
    rows = t.contexts(spark, sf)
    payload = tag_format([("preceding_context", F.col("destination_context"))])
    return rows.select("row_id", prompt(payload).alias("plain_prompt"), prompt(payload, True).alias("judge_prompt"))


@query
def pairs_text(spark, sf):
    split = splitting.stratified_split(t.passage_refs(spark, sf), "passage_id", seed=SEED, strict=False)
    return datasets.pair_dataset(split, t.passages(spark, sf))


@query
def pairs_text_with_source(spark, sf):
    """The older form of the pairs, with source court and date around the passage."""
    rows = t.contexts(spark, sf).withColumn("passage_id", t.tagged("p_", F.col("row_id") % 50))
    split = splitting.stratified_split(rows, "passage_id", seed=SEED, strict=False)
    return datasets.pair_dataset(split, t.passages(spark, sf), "dest_court", source_fields=True)


@query
def e5_queries(spark, sf):
    c = F.col("destination_context")
    return t.contexts(spark, sf).select(
        "row_id",
        e5_query(c).alias("question"),
        e5_query(c, TASK_COURT).alias("court_question"),
        with_instruction(c, CONTEXT_LAYOUT.format(task=TASK_COURT_DATE), "</s>").alias("court_date_question"),
        with_instruction(c, CONTEXT_LAYOUT.format(task=TASK_PLAIN), "</s>").alias("context_question"),
    )


@query
def last_words(spark, sf):
    c = F.col("destination_context")
    return t.contexts(spark, sf).select("row_id", keep_last_words(c, 256).alias("tail"), strip_ws(c).alias("stripped"), word_count(c).cast("bigint").alias("n_words"))


@query
def length_stats(spark, sf):
    return _rounded(audit.length_stats(t.contexts(spark, sf), "destination_context"))


@query
def chat_render(spark, sf):
    return t.chats(spark, sf).select("conv_id", render_chat(F.col("messages")).alias("rendered"))


@query
def chat_eval_prompt(spark, sf):
    return t.chats(spark, sf).select("conv_id", render_chat(F.col("messages"), generation=True).alias("rendered"))


@query
def chat_length_stats(spark, sf):
    return _rounded(audit.length_stats(chat_render(spark, sf), "rendered"))


# ---- datasets end to end ---------------------------------------------------------------------------------------

DOC_PARAMS = DatasetParams(fraction=0.5, seed=SEED, enriched=True)
DOC_ROWS = datasets.Rows(key="row_id", strict=False)


def _flat_chat(chat):
    return chat.select("row_id", "split", F.col("messages")[0]["content"].alias("user"), F.col("messages")[1]["content"].alias("assistant"))


@query
def finetuning_dataset(spark, sf):
    rows = t.contexts(spark, sf).select("row_id", "passage_id", "destination_context", "dest_cite")
    return _flat_chat(datasets.build_chat(rows, DOC_PARAMS, [t.metadata_a(spark, sf), t.metadata_b(spark, sf)], DOC_ROWS))


@query
def classifier_dataset(spark, sf):
    split = datasets.prepare(t.contexts(spark, sf), ["passage_id", "destination_context", "dest_court"], DOC_PARAMS, DOC_ROWS)
    return datasets.classifier_dataset(split, [("DEST COURT", "dest_court")])


@query
def citation_worklist(spark, sf):
    rows = t.contexts_wide(spark, sf).withColumn("destination_context", F.col("row_id"))
    params = DatasetParams(fraction=0.2, seed=SEED)
    return datasets.citation_worklist(rows, params, DOC_ROWS).select("row_id", "passage_id", "dest_cite")


@query
def leak_free_split(spark, sf):
    """Whole texts that are equal, or share their first or last 50 words, on one side of the split."""
    rows = t.contexts(spark, sf).select("row_id", "destination_context")
    found = units.context_units(rows, "destination_context")
    return units.split_units(rows.select("row_id"), found, seed=SEED)


def _joined_by_layout(spark, left, right, key, how="left"):
    a, b = (scratch_dir(spark, name) for name in ("left", "right"))
    return layout.join_laid_out(layout.write_laid_out(left, a, key, 16), layout.write_laid_out(right, b, key, 16, unique=True), how)


@query
def laid_out_metadata(spark, sf):
    """All rows with the metadata of their citation, both laid out by it."""
    meta = enrichment.one_per_key(enrichment.judge_metadata(_meta(spark, sf)), "dest_cite")
    rows = _joined_by_layout(spark, t.contexts_wide(spark, sf), meta, "dest_cite")
    return rows.withColumn("judge_names", F.coalesce(F.array_join("judge_names", ", "), F.lit("")))


@query
def laid_out_passages(spark, sf):
    """Each row's passage from tables laid out by passage, null where it is unknown."""
    rows = _joined_by_layout(spark, t.passage_refs(spark, sf), t.passages(spark, sf), "passage_id")
    return rows.drop("destination_context")


@query
def laid_out_labels(spark, sf):
    """Label numbers of all rows from tables laid out by passage."""
    rows = t.contexts_wide(spark, sf)
    return _bigint(_joined_by_layout(spark, rows, labels.build_label_map(rows), "passage_id", "inner").drop("dest_cite"), "label_idx")


def _ledger(spark, sf, stratum):
    """Orders arrive in three batches; every batch brings the rows of those before it once more."""
    folder = scratch_dir(spark, "ledger")
    orders = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), stratum, "o_orderdate")
    for batch, until in enumerate(("1997-01-01", "1999-01-01", "9999-01-01")):
        ledger.extend_ledger(orders.where(F.col("o_orderdate") < F.lit(until).cast("date")), folder, batch, stratum, seed=SEED)
    return ledger.read_ledger(spark, folder)


@query
def split_ledger(spark, sf):
    """Where each order went and when, in strata of a few rows."""
    return _ledger(spark, sf, "o_custkey").withColumn("batch_id", F.col("batch_id").cast("bigint"))


@query
def split_ledger_counts(spark, sf):
    """Rows of each split after each batch, in a few large strata."""
    rows = _ledger(spark, sf, "o_orderpriority").groupBy("stratum", "batch_id", "split").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("stratum", "split").orderBy("batch_id"))
    return rows.select("stratum", F.col("batch_id").cast("bigint").alias("batch_id"), "split", so_far.alias("n_rows"))


@query
def leak_free_counts(spark, sf):
    """Rows of the splits, and how many units they consist of."""
    rows = t.contexts(spark, sf).select("row_id", "destination_context")
    found = stored(units.context_units(rows, "destination_context"), "units")
    split = units.split_units(rows.select("row_id"), found, seed=SEED).join(found, "row_id")
    return split.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("unit").alias("n_units"))


# ---- baseline scorer -------------------------------------------------------------------------------------------


def _bayes(spark, sf, label="dest_court", **limits):
    rows = t.contexts(spark, sf).select("row_id", label, "destination_context")
    # keys are split, texts only meet their split: they are not sorted by class and hash
    split = stored(splitting.stratified_split(rows.select("row_id", label), label, seed=SEED).select("row_id", "split"), "split")
    train, held = (rows.join(split.where(part), "row_id", "left_semi") for part in ("split = 'train'", "split <> 'train'"))
    return bayes.nb_fit(train, label, "destination_context", **limits), held


def _nb_best(spark, sf, k, *args, **limits):
    model, held = _bayes(spark, sf, *args, **limits)
    best = bayes.nb_topk(model, held, "destination_context", k)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


@query
def nb_topk(spark, sf):
    return _nb_best(spark, sf, 2)


@query
def nb_passages(spark, sf):
    """The passage as class: many classes, of which a text visits few."""
    return _nb_best(spark, sf, 5, "passage_id")


@query
def nb_common_words(spark, sf):
    """Only words that are neither rare nor everywhere."""
    return _nb_best(spark, sf, 2, df_min=2, df_max=400)


@query
def nb_softmax(spark, sf):
    """Class probabilities over two of the courts only."""
    model, held = _bayes(spark, sf)
    two = spark.createDataFrame([("court_en",), ("court_fr",)], "cand_id string")
    scores = bayes.nb_score(model, held, "destination_context", two, digits=12)
    return ranking.restricted_softmax(scores, two).select("query_id", "cand_id", F.round("prob", 6).alias("prob"))


@query
def nb_accuracy(spark, sf):
    """A truth that is not among the two best is a miss for both cut-offs."""
    model, held = _bayes(spark, sf)
    truth = held.select(F.col("row_id").alias("query_id"), F.col("dest_court").alias("truth_id"))
    best = stored(bayes.nb_topk(model, held, "destination_context", 2), "best")
    return _rounded(evaluation.evaluate_scores(best.drop("rank"), truth, (1, 2)))


# ---- round trips -----------------------------------------------------------------------------------------------


@query
def csv_roundtrip(spark, sf):
    folder = scratch_dir(spark, "csv")
    split = splitting.stratified_split(t.contexts(spark, sf), "passage_id", seed=SEED)
    writers.write_splits(split.withColumn("row_id", F.col("row_id").cast("string")), folder, "csv")
    back = readers.read_csv(spark, folder)
    return back.select("row_id", "passage_id", "destination_context", "split")


@query
def contexts_gzip(spark, sf):
    """Compressed files with line ends and quotes in the texts, all columns by name."""
    folder = scratch_dir(spark, "contexts")
    rows = t.contexts(spark, sf).withColumn("row_id", F.col("row_id").cast("string"))
    rows.write.options(**readers.CSV_OPTIONS).option("compression", "gzip").csv(folder)
    return readers.read_contexts(spark, folder).select("row_id", "passage_id", "destination_context", "dest_court")


@query
def keys_roundtrip(spark, sf):
    folder = scratch_dir(spark, "keys")
    t.contexts_wide(spark, sf).write.options(**readers.CSV_OPTIONS).csv(folder)
    return readers.read_keys(spark, folder).groupBy("dest_cite").agg(F.count("*").alias("n_rows"))


@query
def examples_roundtrip(spark, sf):
    """Classifier files written and read as stripped text with a class index."""
    folder = scratch_dir(spark, "examples")
    rows = t.passage_refs(spark, sf).select("passage_id", F.col("destination_context").alias("input_text"))
    writers.write_splits(rows, folder, "csv")
    return _bigint(readers.read_examples(spark, folder, "input_text", labels.build_label_map(t.passages(spark, sf))), "label")


@query
def pairs_roundtrip(spark, sf):
    folder = scratch_dir(spark, "pairs")
    rows = t.passage_refs(spark, sf).select(F.col("destination_context").alias("question"), F.col("passage_id").alias("answer"))
    writers.write_pairs(rows, folder)
    return readers.read_pairs(spark, folder)


@query
def chat_roundtrip(spark, sf):
    folder = scratch_dir(spark, "chat")
    rows = t.contexts(spark, sf)
    writers.write_chat(rows.select(conversation(F.col("destination_context"), F.col("passage_id")).alias("messages")), folder)
    back = readers.read_chat(spark, folder)
    return back.select(F.col("messages")[0]["content"].alias("user"), F.col("messages")[1]["content"].alias("assistant"))


@query
def label_map_roundtrip(spark, sf):
    folder = scratch_dir(spark, "labels")
    writers.write_label_map(labels.build_label_map(t.contexts_wide(spark, sf)), folder)
    return _bigint(readers.read_label_map(spark, folder), "label_idx")


@query
def passages_roundtrip(spark, sf):
    folder = scratch_dir(spark, "passages")
    writers.write_splits(t.passages(spark, sf), folder)
    return spark.read.parquet(folder)


@query
def metadata_roundtrip(spark, sf):
    """Two metadata files read back by two of their columns."""
    folders = [scratch_dir(spark, "metadata") for _ in range(2)]
    for rows, folder in zip((t.metadata_a(spark, sf), t.metadata_b(spark, sf)), folders):
        writers.write_splits(rows.withColumn("court", F.lit("x")), folder, "csv")
    return readers.read_metadata(spark, folders)


@query
def cache_roundtrip(spark, sf):
    """One batch written twice is there once."""
    folder = scratch_dir(spark, "cache")
    rows = enrichment.parse_lookup(t.responses(spark, sf))
    for _ in range(2):
        writers.append_cache(rows, folder, 0)
    return _flat(read_enriched(spark, folder).drop("batch_id"))


# ---- embedding -------------------------------------------------------------------------------------------------


@query
def embed_hash(spark, sf):
    """Vectors of whole texts from a hashing stand-in model, one row per dimension."""
    rows = t.contexts(spark, sf).select("row_id", "destination_context")
    made = embedding.embed(rows, "destination_context", embedding.hashing_encoder(EMBED_DIM), EMBED_DIM)
    cells = made.select("row_id", F.posexplode("vec").alias("dim", "value"))
    return cells.select("row_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 4).alias("value"))


@query
def embedding_retrieval(spark, sf):
    """From contexts and passages to ranks: split, pair, instruct, encode, rank among the distinct passages."""
    split = splitting.stratified_split(t.passage_refs(spark, sf), "passage_id", seed=SEED, strict=False)
    pairs = datasets.pair_dataset(split, t.passages(spark, sf)).where("split <> 'train'")
    asked = materialise(pairs.withColumn("question", e5_query(F.col("question"))).drop("split"))
    return evaluation.ranks_of_pairs(asked, embedding.hashing_encoder(EMBED_DIM), EMBED_DIM)


@query
def embedding_accuracy(spark, sf):
    return _rounded(metrics.topk_accuracy(embedding_retrieval(spark, sf)))

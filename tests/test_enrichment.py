import pytest
from pyspark.sql import functions as F

from citeflow.operators import audit, enrichment
from citeflow.schemas import METADATA
from citeflow.streaming.enrichment import enrich_batch, read_enriched, start_enrichment

CASES = [
    # cite, lookup, cluster, status, matches
    ("", '[{"clusters":["u"]}]', '{"id":1}', "error", 0),
    (None, None, None, "error", 0),
    ("c1", None, None, "timeout_error", 0),
    ("c2", "[]", None, "timeout_error", 0),
    ("c3", "not json", None, "timeout_error", 0),
    ("c4", '[{"clusters":[]}]', None, "not_found", 1),
    ("c5", '[{}, {"clusters":["u"]}]', None, "not_found", 2),
    ("c6", '[{"clusters":[{"url":"","resource_uri":""}]}]', '{"id":1}', "not_found", 1),
    ("c7", '[{"clusters":["u"]}]', "{}", "cluster_timeout_error", 1),
    ("c8", '[{"clusters":["u"]}]', None, "cluster_timeout_error", 1),
    ("c9", '[{"clusters":[{"url":"u"}]}]', '{"id":0,"pk":5}', "ok", 1),
    ("c10", '[{"clusters":[{"url":"","resource_uri":"r"}]}]', '{"judges":"A, B,,"}', "ok", 1),
    ("c11", '{"detail":"x"}', None, "processing_error", 1),
    ("c12", '["text"]', None, "processing_error", 1),
    ("c13", '[{"clusters":["u"]}]', "[1]", "processing_error", 1),
    ("c14", '[{"clusters":"u"}]', '{"id":1}', "not_found", 1),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([c[:3] for c in CASES], "dest_cite string, lookup_json string, cluster_json string")
    return {r.dest_cite: r for r in enrichment.parse_lookup(df).collect()}


def test_status(parsed):
    assert {k: (r.status, r.lookup_matches) for k, r in parsed.items()} == {c[0]: (c[3], c[4]) for c in CASES}


def test_fields(spark):
    body = (
        '{"id":7,"caseName":"N","court":{"name":"C"},"dateFiled":"2001-01-01","author_str":"","author":"Z",'
        '"panel":[],"panel_str":"P","judges":["A",""," B "]}'
    )
    df = spark.createDataFrame([("x", '[{"clusters":["u"]}]', body)], "dest_cite string, lookup_json string, cluster_json string")
    row = enrichment.parse_lookup(df).first()
    assert row.asDict() == {
        "dest_cite": "x",
        "case_name": "N",
        "court": "C",
        "date_filed": "2001-01-01",
        "opinion_id": None,
        "cluster_id": 7,
        "author_judge": "Z",
        "judge_names": ["A", " B "],
        "panel_text": "P",
        "status": "ok",
        "lookup_matches": 1,
    }


def test_judges_text_absent_and_id_fallback(parsed):
    assert parsed["c10"].judge_names == ["A", "B"]
    assert parsed["c9"].judge_names == [] and parsed["c9"].cluster_id == 5


def test_empty_list_may_count_as_not_found(spark):
    df = spark.createDataFrame([("a", "[]", None)], "dest_cite string, lookup_json string, cluster_json string")
    assert enrichment.parse_lookup(df, empty_is_not_found=True).first().status == "not_found"


@pytest.fixture
def service(spark):
    answers = spark.createDataFrame(
        [("a", '[{"clusters":["u"]}]', '{"id":1}'), ("b", None, None)], "dest_cite string, lookup_json string, cluster_json string"
    )
    return enrichment.landed(answers)


def test_second_run_adds_nothing(spark, service):
    work = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "dest_cite string")
    empty = spark.createDataFrame([], METADATA)
    once = enrichment.enrich_incremental(work, service, empty).cache()
    assert {(r.dest_cite, r.status) for r in once.collect()} == {("a", "ok"), ("b", "timeout_error")}
    twice = enrichment.enrich_incremental(work, service, once)
    assert twice.count() == 2
    summary = audit.progress(work, once).first()
    assert (summary.total, summary.processed, summary.remaining, summary.cached) == (2, 2, 0, 2)


def test_failures_are_tried_again_when_asked(spark, service):
    work = spark.createDataFrame([("a",), ("b",)], "dest_cite string")
    once = enrichment.enrich_incremental(work, service, spark.createDataFrame([], METADATA)).cache()
    now = spark.createDataFrame([("b", '[{"clusters":[]}]', None)], "dest_cite string, lookup_json string, cluster_json string")
    again = enrichment.enrich_incremental(work, enrichment.landed(now), once, ("timeout_error",))
    assert {(r.dest_cite, r.status) for r in again.collect()} == {("a", "ok"), ("b", "not_found")}


def test_lookup_from_the_executors(spark):
    def fn(keys):
        return [(f'[{{"clusters":["{k}"]}}]', '{"id":3}') for k in keys]

    work = spark.createDataFrame([(" a ",), ("b",)], "dest_cite string")
    got = enrichment.lookup_with(work, fn).orderBy("dest_cite").collect()
    assert [(r.dest_cite, r.lookup_json) for r in got] == [(" a ", '[{"clusters":["a"]}]'), ("b", '[{"clusters":["b"]}]')]


def test_stream_runs_and_replay(spark, service, tmp_path):
    source, cache, progress = (str(tmp_path / n) for n in ("in", "cache", "progress"))

    def run():
        arriving = spark.readStream.schema("dest_cite string").parquet(source)
        start_enrichment(arriving, service, cache, progress).awaitTermination()

    spark.createDataFrame([("a",), ("a",)], "dest_cite string").write.parquet(source)
    run()
    spark.createDataFrame([("a",), ("b",)], "dest_cite string").write.mode("append").parquet(source)
    run()
    run()
    first = {(r.dest_cite, r.batch_id) for r in read_enriched(spark, cache).collect()}
    assert first == {("a", 0), ("b", 1)}
    enrich_batch(spark.createDataFrame([("a",), ("b",)], "dest_cite string"), service, cache, 1)
    assert {(r.dest_cite, r.batch_id) for r in read_enriched(spark, cache).collect()} == first


def test_latest_attempt(spark):
    df = spark.createDataFrame([("a", "timeout_error", 0), ("a", "ok", 1), ("b", "ok", 0)], "dest_cite string, status string, batch_id long")
    assert {(r.dest_cite, r.status) for r in enrichment.latest_attempt(df).collect()} == {("a", "ok"), ("b", "ok")}


def test_coverage_counts_empty_lists_as_missing(spark):
    df = spark.createDataFrame([("train", ["A"]), ("train", []), ("test", None)], "split string, judge_names array<string>")
    got = {r.split: r.judge_names_coverage for r in audit.coverage(df, ["judge_names"]).collect()}
    assert got == {"train": 0.5, "test": 0.0}


def test_leakage_check(spark):
    with pytest.raises(ValueError, match="source_court"):
        audit.assert_no_leakage(spark.range(1).withColumn("source_court", F.lit("x")))
    assert audit.assert_no_leakage(spark.range(1)).columns == ["id"]


def test_overlap_and_distinct(spark):
    df = spark.createDataFrame([("train", "x"), ("test", "x"), ("train", "y"), ("train", "y"), ("test", None)], "split string, t string")
    got = audit.split_overlap(df, ["t"]).collect()
    assert [(r.splits, r.n_rows) for r in got] == [("test,train", 2)]
    assert {r.split: r.distinct_values for r in audit.distinct_count(df, "t").collect()} == {"train": 2, "test": 2}

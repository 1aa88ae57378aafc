import pytest
from pyspark.sql import functions as F

from citeflow.operators import dedup, enrichment, labels
from citeflow.operators.joins import join_spread
from citeflow.schemas import with_row_id


@pytest.fixture(scope="module")
def left(spark):
    rows = [("hot", i) for i in range(200)] + [(f"k{i}", i) for i in range(20)] + [(None, -1), ("lost", -2)]
    return spark.createDataFrame(rows, "dest_cite string, n int").cache()


@pytest.fixture(scope="module")
def meta(spark):
    rows = [("hot", "['B']"), ("hot", "['A']"), (None, "['N']")] + [(f"k{i}", f"['J{i}']") for i in range(15)]
    return spark.createDataFrame(rows, "dest_cite string, judge_names string").cache()


def rows(df):
    return sorted((tuple("" if v is None else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_spread_join_is_the_plain_join(left, meta, how, null_safe):
    other = meta.withColumnRenamed("dest_cite", "r")
    match = F.col("dest_cite").eqNullSafe(F.col("r")) if null_safe else F.col("dest_cite") == F.col("r")
    wanted = rows(left.join(other, match, how).drop("r"))
    for hot_rows in (10, 1_000_000):
        assert rows(join_spread(left, meta, "dest_cite", how, null_safe, hot_rows)) == wanted


def test_hot_rows_are_spread(left, meta):
    text = join_spread(left, meta, "dest_cite", "left", hot_rows=10)._jdf.queryExecution().toString()
    assert "_rslice" in text


def test_enrich(left, meta):
    first = enrichment.enrich(left, meta, hot_rows=10)
    assert first.count() == left.count()
    assert first.where("dest_cite = 'hot'").select("judge_names").distinct().count() == 1
    assert first.where("n = -1").first().judge_names is None
    assert enrichment.enrich(left, meta, null_safe=True).where("n = -1").first().judge_names == "['N']"
    assert enrichment.enrich(left, meta, on_dup="fanout", hot_rows=10).count() == left.count() + 200
    with pytest.raises(ValueError, match="several"):
        enrichment.enrich(left, meta, on_dup="error")
    with pytest.raises(ValueError):
        enrichment.enrich(left, meta, on_dup="some")


def test_successful_metadata_first(spark):
    df = spark.createDataFrame([("a", "not_found", None), ("a", "ok", "x"), ("b", "error", None)], "dest_cite string, status string, court string")
    assert {(r.dest_cite, r.status) for r in enrichment.one_per_key(df, "dest_cite").collect()} == {("a", "ok"), ("b", "error")}


def test_dedup_looks_at_all_columns(spark):
    df = spark.createDataFrame([("p", "t", "x"), ("p", "t", "x"), ("p", "t", None), ("p", "t", None), ("q", None, "x")], "a string, b string, c string")
    got = dedup.dedup_project(df, ["a", "b"], row_id="row_id")
    assert got.count() == 3 and got.select("row_id").distinct().count() == 3
    assert dedup.dedup_project(df, ["a", "b", "c"]).count() == 3
    assert with_row_id(df).select("row_id").distinct().count() == 3


def test_distinct_keys(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 2), (None, 0)], "k string, n int")
    assert rows(dedup.distinct_keys(df, "k")) == [("a",), ("b",)]
    assert rows(dedup.distinct_keys(df, "k", "n")) == [("a", 2), ("b", 1)]


def test_label_order(spark):
    ids = spark.createDataFrame([("a_10",), ("a_2",), ("b_2",), ("c_1",), ("a_2",), ("x",), (None,)], "passage_id string")
    for hot_rows in (1, 100):
        got = labels.build_label_map(ids, hot_rows=hot_rows)
        assert [r.passage_id for r in got.orderBy("label_idx").collect()] == ["c_1", "a_2", "b_2", "a_10", "x"]
        tokens = {r.passage_id: r.token for r in got.collect()}
        assert tokens == {k: f"<special_token_{i}>" for i, k in enumerate(sorted(tokens), 1)}


def test_encode(spark):
    made = labels.build_label_map(spark.createDataFrame([("a_1",), ("a_2",)], "passage_id string"))
    data = spark.createDataFrame([("a_1",), ("a_3",), ("a_1",)], "passage_id string")
    assert labels.encode_labels(data, made, "drop", hot_rows=1).count() == 2
    with pytest.raises(KeyError, match="a_3"):
        labels.encode_labels(data, made)
    assert labels.encode_labels(data.where("passage_id <> 'a_3'"), made).count() == 2
    decoded = labels.decode_labels(labels.encode_labels(data, made, "drop").select("label_idx"), made)
    assert {r.passage_id for r in decoded.collect()} == {"a_1"}
    assert labels.check_label_count(made, 2) is made
    with pytest.raises(ValueError):
        labels.check_label_count(made, 3)

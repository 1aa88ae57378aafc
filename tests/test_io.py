import gzip
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from citeflow.functions import conversation
from citeflow.operators import labels
from citeflow.plans import datasets
from citeflow.params import DatasetParams
from citeflow.schemas import METADATA
from citeflow.sources import readers, writers

TEXTS = ["cr\r\nlf", "a,b", 'say ""no""', "two\nlines", "ends with \\", "  blanks  ", "", None, 'q"', "tab\t"]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(str(i), t, "train") for i, t in enumerate(TEXTS)], "i string, t string, split string")


def test_csv_round_trip(spark, texts, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_splits(texts, path, "csv")
    got = {r.i: r.t for r in readers.read_csv(spark, path).collect()}
    # CSV cannot tell empty text from missing text; Parquet can
    assert got == {str(i): t or None for i, t in enumerate(TEXTS)}
    writers.write_splits(texts, str(tmp_path / "parquet"))
    assert {r.i: r.t for r in spark.read.parquet(str(tmp_path / "parquet")).collect()} == {str(i): t for i, t in enumerate(TEXTS)}


def test_contexts_from_gzip(spark, tmp_path):
    path = str(tmp_path / "top.csv.gz")
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write('other,passage_id,destination_context,dest_cite\n1,p_1,"a, ""b""\nc\\",x\n2,p_2,é,\n')
    got = readers.read_contexts(spark, path, partitions=3).orderBy("passage_id").collect()
    assert [(r.passage_id, r.destination_context, r.dest_cite, r.other) for r in got] == [("p_1", 'a, "b"\nc\\', "x", "1"), ("p_2", "é", None, "2")]
    assert [r.dest_cite for r in readers.read_keys(spark, path).collect()] == ["x", None]


def test_passages_and_label_map_documents(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"data": {"a_1": "x\ny", "a_2": "z"}}, indent=1))
    assert {tuple(r) for r in readers.read_passages(spark, str(tmp_path / "p.json")).collect()} == {("a_1", "x\ny"), ("a_2", "z")}
    (tmp_path / "m.json").write_text(json.dumps({"a_10": "<special_token_1>", "a_2": "<special_token_2>"}, indent=2))
    got = {tuple(r) for r in readers.read_label_map(spark, str(tmp_path / "m.json")).collect()}
    assert got == {("a_10", "<special_token_1>", 1), ("a_2", "<special_token_2>", 0)}


def test_pairs_document(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps({"queries": ["q0", "q1"], "paragraphs": ["a0", None]}))
    assert {tuple(r) for r in readers.read_pairs_document(spark, str(tmp_path / "ok.json")).collect()} == {(0, "q0", "a0"), (1, "q1", None)}
    (tmp_path / "bad.json").write_text(json.dumps({"queries": ["q0", "q1"], "paragraphs": ["a0"]}))
    with pytest.raises(Exception, match="differ in length"):
        readers.read_pairs_document(spark, str(tmp_path / "bad.json")).collect()


def test_chat(spark, tmp_path):
    rows = spark.range(3).select(conversation(F.lit("ü\n"), F.col("id").cast("string")).alias("messages"), F.lit("test").alias("split"))
    writers.write_chat(rows, str(tmp_path / "chat"))
    got = readers.read_chat(spark, str(tmp_path / "chat"))
    assert sorted(m.messages[1].content for m in got.collect()) == ["0", "1", "2"]
    (tmp_path / "doc.json").write_text(json.dumps({"messages": [[{"role": "user", "content": "a"}], [{"role": "user", "content": "b"}]]}))
    assert [r.messages[0].content for r in readers.read_chat_document(spark, str(tmp_path / "doc.json")).orderBy("sample_id").collect()] == ["a", "b"]
    (tmp_path / "no.json").write_text(json.dumps({"other": 1}))
    with pytest.raises(KeyError):
        readers.read_chat(spark, str(tmp_path / "no.json"))
    with pytest.raises(KeyError):
        readers.read_chat_document(spark, str(tmp_path / "no.json"))


def test_examples(spark, tmp_path):
    rows = spark.createDataFrame([("a_1", " x "), ("a_9", "y")], "passage_id string, input_text string")
    writers.write_splits(rows, str(tmp_path / "ex"), "csv")
    assert {tuple(r) for r in readers.read_examples(spark, str(tmp_path / "ex"), "input_text").collect()} == {("x", "a_1"), ("y", "a_9")}
    made = labels.build_label_map(rows.limit(1))
    assert [tuple(r) for r in readers.read_examples(spark, str(tmp_path / "ex"), "input_text", made).collect()] == [("x", 0)]


def test_cache_hides_only_a_missing_table(spark, tmp_path):
    assert readers.read_cache(spark, str(tmp_path / "none"), METADATA).count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception) as e:
        readers.read_cache(spark, str(tmp_path / "broken"), METADATA).collect()
    assert not isinstance(e.value, AnalysisException) or e.value.getCondition() != "PATH_NOT_FOUND"


def test_build_without_a_key(spark):
    """Copies go, every passage of the train rows gets a token, and the answer is the passage's own token."""
    rows = [(f"p_{i % 4}", f"text {i}", f"cite_{i % 10}", "x") for i in range(120)]
    contexts = spark.createDataFrame(rows + rows[:40], "passage_id string, destination_context string, dest_cite string, source_date string")
    meta = spark.createDataFrame([("cite_1", "['A', 'B']")], "dest_cite string, judge_names string")
    made = datasets.build_chat(contexts, DatasetParams(fraction=0.5, enriched=True), [meta], datasets.Rows(hot_rows=10)).cache()
    assert made.count() == 60
    assert {r.split: r["count"] for r in made.groupBy("split").count().collect()} == {"train": 48, "valid": 6, "test": 6}
    assert made.select("passage_id", F.col("messages")[1]["content"].alias("t")).distinct().count() == 4
    asked = [r.messages[0].content for r in made.collect()]
    assert any("<JUDGES>A, B</JUDGES>" in a for a in asked) and all("source_date" not in a for a in asked)
    work = datasets.citation_worklist(contexts, DatasetParams(fraction=1.0))
    assert work.count() == 96 and "dest_cite" in work.columns

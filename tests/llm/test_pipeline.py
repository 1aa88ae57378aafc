"""The pipeline's stages take effect, keep the columns of documents and take odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    secret = [(10_001, "the password = hunter22 was of the " + "and that is on with for " * 12, "en", "s", 5)]
    odd = [(10_000, None, None, None, None), (None, "", None, None, None), (10_002, "12 34", "en", "s", 5), *secret]
    return documents.unionByName(spark.createDataFrame(odd, documents.schema))


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "ngram_jaccard", "secret_scans", "best_fit_packing"]
    now = docs
    counts = [now.count()]
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = corpus_pipeline.stored(stage(spark, now, SF), "t")
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts[0] > counts[2] > counts[3] == counts[4] and counts[1] <= counts[0]
    texts = {r.doc_id: r for r in now.collect()}
    assert 10_000 not in texts and 10_002 not in texts
    assert texts[10_001].text.startswith("the [assign] was") and texts[10_001].n_chars == len(texts[10_001].text)
    packed = corpus_pipeline.best_fit_packing(spark, now, SF)
    assert packed.select("doc_id").distinct().count() == counts[4] and packed.where(F.col("length") > 1024).count() == 0

import csv
import json

import pytest
from pyspark.sql import functions as F

from citeflow.jobs import main


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    with open(folder / "contexts.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["passage_id", "destination_context", "dest_court", "source_court", "source_date", "dest_cite"])
        for i in range(200):
            out.writerow([f"p_{i % 5}", f'context "{i}",\nmore', "C", "S", "2000", f"cite_{i % 50}"])
    with open(folder / "meta.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["dest_cite", "case_name", "judge_names"])
        for i in range(0, 50, 2):
            out.writerow([f"cite_{i}", "n", "['A', \"O'B\"]"])
    (folder / "passages.json").write_text(json.dumps({"data": {f"p_{i}": f"passage {i}" for i in range(9)}}))
    return folder


def test_jobs_in_order(spark, files, tmp_path):
    out, base = str(tmp_path), ["--contexts", str(files / "contexts.csv"), "--fraction", "0.5", "--out", str(tmp_path)]
    main(["finetuning-data", *base, "--enriched", "--metadata", str(files / "meta.csv")], spark)
    tag = "extended_10k_percent50_split801010_seed42"
    chat = spark.read.json(f"{out}/chat/{tag}")
    assert chat.count() == 100 and {r.split for r in chat.select("split").distinct().collect()} == {"train", "valid", "test"}
    assert chat.where(F.col("messages")[0]["content"].contains("<JUDGES>A, O'B</JUDGES>")).count() > 0

    main(["check-labels", "--label-map", f"{out}/label_map/{tag}", "--classes", "5"], spark)
    with pytest.raises(ValueError):
        main(["check-labels", "--label-map", f"{out}/label_map/{tag}", "--classes", "6"], spark)

    main(["classifier-data", *base, "--enriched", "--format", "csv"], spark)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{out}/classifier/{tag}")
    assert rows.count() == 100 and rows.where("input_text like '<DEST COURT>C</DEST COURT> <DEST CONTEXT>context%'").count() == 100

    main(["pair-data", *base, "--passages", str(files / "passages.json"), "--label-map", f"{out}/label_map/{tag}", "--instruction", "query"], spark)
    pairs = spark.read.json(f"{out}/pairs/10k_percent50_split801010_seed42")
    assert pairs.count() == 100 and pairs.where("question like 'Instruct: %Query: context%' and answer like 'passage %'").count() == 100

    main(["uncovered-citations", "--contexts", str(files / "contexts.csv"), "--metadata", str(files / "meta.csv"), "--out", out], spark)
    assert spark.read.parquet(f"{out}/uncovered").count() == 25
    main(["citation-worklist", *base], spark)
    work = spark.read.parquet(f"{out}/worklist/10k_percent50_split801010_seed42")
    assert work.count() == 80
    work.select("dest_cite").write.parquet(f"{out}/arrived")
    cites = work.select("dest_cite").distinct()
    answers = cites.select("dest_cite", F.lit('[{"clusters":["u"]}]').alias("lookup_json"), F.lit('{"id":1,"judges":"X, Y"}').alias("cluster_json"))
    answers.write.parquet(f"{out}/answers")
    main(["collect-metadata", "--worklist", f"{out}/arrived", "--responses", f"{out}/answers", "--out", f"{out}/meta"], spark)
    final = spark.read.parquet(f"{out}/meta/metadata")
    assert final.count() == cites.count() and final.where("status = 'ok' and size(judge_names) = 2").count() == cites.count()


def test_evaluation_jobs(spark, tmp_path):
    out = str(tmp_path)
    vecs = [(i, [1.0, float(i)], [1.0, float(i)]) for i in range(6)]
    spark.createDataFrame(vecs, "pair_id long, question_vec array<float>, answer_vec array<float>").write.parquet(f"{out}/pairs")
    main(["evaluate-vectors", "--pairs", f"{out}/pairs", "--out", out], spark)
    main(["evaluate-vectors", "--pairs", f"{out}/pairs", "--out", f"{out}/some", "--samples", "2"], spark)
    assert spark.read.json(f"{out}/some/accuracy").first().evaluated == 2
    texts = spark.read.parquet(f"{out}/pairs").selectExpr("*", "'q' as question", "'a' as answer")
    texts.write.parquet(f"{out}/texts")
    main(["retrieval-examples", "--pairs", f"{out}/texts", "--out", out, "--samples", "2"], spark)
    assert spark.read.json(f"{out}/examples").where("truth_rank = 1").count() == 6
    row = spark.read.json(f"{out}/accuracy").first()
    assert row.top_1_accuracy == 1.0 and row.evaluated == 6
    assert spark.read.json(f"{out}/ir_metrics").first().mrr_at_10 == 1.0
    spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.9)], "query_id long, cand_id long, score double").write.parquet(f"{out}/scores")
    spark.createDataFrame([(0, 0)], "query_id long, truth_id long").write.parquet(f"{out}/truth")
    main(["evaluate-scores", "--scores", f"{out}/scores", "--truth", f"{out}/truth", "--out", f"{out}/s"], spark)
    assert spark.read.json(f"{out}/s/accuracy").first().top_5_accuracy == 1.0

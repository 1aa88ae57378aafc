"""Time the headline queries and print one JSON line: ``BENCH_SF_DIR=.. BENCH_CPUS=.. python bench.py [name ..]``."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from citeflow.session import local_session  # noqa: E402

HEADLINE = [
    "topk_accuracy_pairs",
    "ir_metrics_pairs",
    "top10_neighbours_blocked",
    "class_softmax_topk",
    "dedup_project",
    "sample_per_group",
    "stratified_split",
    "batches",
    "label_map",
    "encode_labels",
    "enrich_first",
    "coverage",
    "parse_lookup",
    "enrich_incremental",
    "tagged_text",
    "e5_queries",
    "last_words",
    "finetuning_dataset",
    "citation_worklist",
    "nb_topk",
    "csv_roundtrip",
    "embed_hash",
    "streaming_enrichment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()

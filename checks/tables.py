"""Stand-in inputs over the test tables, each one over its whole table. The SQL side has its own in ``oracles.py``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.sources.readers import spread_few_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # long texts are worth moving when one task would otherwise do all their work
    return spread_few_files(rows) if name in ("documents", "conversations") else rows


def tagged(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def contexts(spark, sf):
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        doc.alias("row_id"),
        F.concat(F.lit("p_"), F.expr("substring(source, 4)")).alias("passage_id"),
        F.col("text").alias("destination_context"),
        tagged("court_", F.col("lang")).alias("dest_court"),
        tagged("court_", doc % 7).alias("source_court"),
        F.concat((1960 + doc % 40).cast("string"), F.lit("-01-01")).alias("source_date"),
        tagged("cite_", doc % 300).alias("dest_cite"),
    )


def contexts_dup(spark, sf):
    """Contexts without a key, those of one court twice."""
    rows = contexts(spark, sf).drop("row_id")
    return rows.unionByName(rows.where(F.col("dest_court") == "court_en"))


def contexts_wide(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat_ws(
            "|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")]
        ).alias("row_id"),
        tagged("p_", F.col("l_partkey")).alias("passage_id"),
        tagged("cite_", F.col("l_orderkey")).alias("dest_cite"),
    )


def _orders(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def metadata_a(spark, sf):
    """Judges of the finished orders: customer and nation."""
    nation = table(spark, sf, "nation")
    rows = _orders(spark, sf).where(F.col("o_orderstatus") == "F").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    names = F.concat(F.lit("['"), F.col("c_name"), F.lit("', '"), F.col("n_name"), F.lit("']"))
    return rows.select(tagged("cite_", F.col("o_orderkey")).alias("dest_cite"), names.alias("judge_names"))


def metadata_b(spark, sf):
    """Judges of the urgent orders, some of which are in the other file too: customer only."""
    rows = _orders(spark, sf).where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    names = F.concat(F.lit("['"), F.col("c_name"), F.lit("']"))
    return rows.select(tagged("cite_", F.col("o_orderkey")).alias("dest_cite"), names.alias("judge_names"))


def passages(spark, sf):
    return table(spark, sf, "benchmark").select(tagged("p_", F.col("item_id")).alias("passage_id"), F.col("text").alias("passage"))


def passage_refs(spark, sf):
    """References to passages, some of which do not exist."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), tagged("p_", F.col("doc_id") % 50).alias("passage_id"), F.col("text").alias("destination_context")
    )


def responses(spark, sf):
    """Landed lookup responses, one kind of outcome per remainder."""
    kind, name = F.col("c_custkey") % 7, F.col("c_name")
    lookup = (
        F.when(kind == 1, "[]")
        .when(kind == 2, '[{"clusters":[]}]')
        .when(kind == 3, '[{"clusters":["u/1"]}]')
        .when(kind == 4, '[{"clusters":[{"url":"u/2"}]},{"clusters":[]}]')
        .when(kind == 5, '[{"clusters":[{"resource_uri":"u/3"}]}]')
        .when(kind == 6, '{"detail":"moved"}')
    )
    cluster = F.when(
        kind == 3, F.concat(F.lit('{"id":7,"caseName":"'), name, F.lit('","court":{"name":"C"},"judges":"A, B,,"}'))
    ).when(
        kind == 4,
        F.concat(F.lit('{"pk":8,"case_name":"'), name, F.lit('","court":"D","author_str":"","author":"Z","judges":["A",""]}')),
    )
    return table(spark, sf, "customer").select(
        tagged("cite_", F.col("c_custkey")).alias("dest_cite"), lookup.alias("lookup_json"), cluster.alias("cluster_json")
    )


def arriving(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", tagged("cite_", F.col("user_id")).alias("dest_cite"))


def pairs(spark, sf):
    """Vectors as question-answer pairs: two neighbours by id are one pair, every vector plays one role."""
    vec = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.floor(vec / 2).cast("bigint").alias("pair_id"), (vec % 2 == 0).alias("asks"), F.col("embedding").alias("vec")
    )


def pair_queries(spark, sf):
    return pairs(spark, sf).where("asks").select(F.col("pair_id").alias("query_id"), "vec")


def pair_corpus(spark, sf):
    return pairs(spark, sf).where("not asks").select(F.col("pair_id").alias("cand_id"), "vec")


def pair_truth(spark, sf):
    return pair_queries(spark, sf).select("query_id", F.col("query_id").alias("truth_id"))


def class_queries(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), F.col("label").cast("bigint").alias("truth"))


def class_means(spark, sf):
    """Mean vector of each label."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_cells"))
    return vectors.select(F.col("label").cast("bigint").alias("cand_id"), F.col("_cells.x").alias("vec"))


def chats(spark, sf):
    """Conversations with their turns in order."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("_turns")
    )
    message = lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
    return turns.select("conv_id", F.transform("_turns", message).alias("messages"))

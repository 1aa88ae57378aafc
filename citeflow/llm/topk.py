"""Exact top-k inner products by norm buckets.

Vectors are grouped by length. A query with a lower bound on its k-th score needs a bucket only if its own length times
the bucket's greatest length reaches the bound; the bound divided by that product is the bucket's local cosine
threshold. Inside a bucket, a low threshold is used on lengths (its vectors are sorted by length, so a prefix is left),
a high one on coordinates (a vector whose cosine reaches it must lie close to the query in every coordinate). Whatever
is left is verified with exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeflow.llm.frames import col, stored

#: Vectors and queries that meet in one task: memory is bounded by the two and their products.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 512
#: Lengths of a bucket lie within this factor; a hot length is split into blocks.
LENGTH_STEP = 1.05
#: From this local cosine threshold on, coordinates are looked at; below it they would keep nearly everything.
COORDINATE_COSINE = 0.9
FOCUS = 4


def whole_numbers(vector: Column, factor: float) -> Column:
    """floor(factor * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lengths = rows.flatten().to_numpy(zero_copy_only=False), np.diff(rows.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(lengths), width))
    inside = np.arange(width)[None, :] < lengths[:, None]
    out[inside] = flat
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_block(queries: pd.DataFrame, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's best k in one block of vectors; ``queries`` has query_id and bound."""
    if not len(ids) or not len(queries):
        return []
    lengths = np.linalg.norm(v, axis=1)
    order = np.argsort(-lengths, kind="stable")
    ids, v, lengths = ids[order], v[order], lengths[order]
    query_lengths = np.linalg.norm(q, axis=1)
    bounds = queries["bound"].to_numpy(dtype=np.float64, na_value=-np.inf)
    slack = 1e-9
    reach = query_lengths * lengths[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(bounds <= 0, -1.0, bounds / reach)
    alive = ~(bounds > reach * (1 + slack))
    by_coordinate = alive & (local >= COORDINATE_COSINE) & (local <= 1)
    out: list[tuple[int, int, int]] = []
    query_ids = queries["query_id"].to_numpy(dtype=np.int64)

    def add(row: int, at: np.ndarray, scores: np.ndarray) -> None:
        keep = (ids[at] != query_ids[row]) & (scores >= bounds[row])
        at, scores = at[keep], scores[keep]
        for j in _best(scores, ids[at], k):
            out.append((int(query_ids[row]), int(ids[at[j]]), int(scores[j])))

    if by_coordinate.any():
        directions = v / np.maximum(lengths, 1e-300)[:, None]
        for row in np.flatnonzero(by_coordinate):
            unit = q[row] / query_lengths[row]
            at = np.arange(np.searchsorted(-lengths, -bounds[row] / query_lengths[row] * (1 - slack), "right"))
            for focus in np.argsort(-np.abs(unit))[:FOCUS]:
                # the angle to an axis differs from the query's by no more than the angle between the two vectors
                angle, apart = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(float(local[row]), 1.0))
                low = np.cos(min(np.pi, angle + apart)) - 1e-7
                high = np.cos(max(0.0, angle - apart)) + 1e-7
                x = directions[at, focus]
                at = at[(x >= low) & (x <= high)]
            add(row, at, v[at] @ q[row])
    rows = np.flatnonzero(alive & ~by_coordinate)
    if len(rows):
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(bounds[rows] <= 0, 0.0, bounds[rows] / query_lengths[rows] * (1 - slack))
        prefix = np.searchsorted(-lengths, -need, "right")
        products = v[: prefix.max()] @ q[rows].T
        for j, row in enumerate(rows):
            add(row, np.arange(prefix[j]), products[: prefix[j], j])
    return out


def _search(k: int, width: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        queries = left.select(["query_id", "bound"]).to_pandas()
        found = []
        q, ids, v = _matrix(left["q"], width), right["vec_id"].to_numpy(), _matrix(right["v"], width)
        for at in range(0, len(queries), BLOCK_QUERIES):
            part = slice(at, at + BLOCK_QUERIES)
            found += search_block(queries[part], q[part], ids, v, k)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    run.__annotations__ = {"key": tuple, "left": pa.Table, "right": pa.Table, "return": pa.Table}
    return run


def _meet(queries: DataFrame, vectors: DataFrame, blocks: DataFrame, n_parts: int, k: int, width: int) -> DataFrame:
    """Best k of each query in each block that its bound lets it reach; ``blocks`` has a row per block of vectors."""
    reached = F.col("bound").isNull() | (F.col("bound") <= F.col("q_length") * F.col("longest") * F.lit(1 + 1e-9))
    parts = F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part")
    reach = blocks.select("bucket", "block", "longest", parts)
    sent = queries.join(reach, "part").where(reached).select("query_id", "bound", "q", "part", "bucket", "block")
    met = vectors.join(blocks, ["bucket", "block"]).select("vec_id", "v", "bucket", "block", parts)
    key = ["part", "bucket", "block"]
    found = sent.groupBy(*key).cogroup(met.groupBy(*key))
    return found.applyInArrow(_search(k, width), "query_id bigint, vec_id bigint, score bigint")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    factor: float = 64,
    key: str = "vec_id",
    vector: str = "embedding",
    block_vectors: int = BLOCK_VECTORS,
    part_queries: int = 8 * BLOCK_QUERIES,
) -> DataFrame:
    """Each query's ``k`` highest integer inner products with all rows of ``vectors`` but its own id.

    Components become floor(factor * x); scores are exact below 2**53. Returns ``query_id``, ``rank`` (from 1, ties to
    the smaller id), ``vec_id`` and ``score``; fewer rows where there are fewer candidates. Vectors that are null or
    hold a null or non-finite component take no part, nor do null ids; shorter vectors count as filled with zeros.
    Repeated rows are candidates each for itself; a query id that occurs several times is asked once, with its greatest
    vector. A first round in the blocks of the longest vectors gives each query a lower bound on its k-th score; the
    second visits only blocks that can reach it.
    """

    def whole(df: DataFrame) -> DataFrame:
        usable_rows = df.select(col(key).cast("bigint").alias("vec_id"), col(vector).alias("e")).where(
            F.col("vec_id").isNotNull() & usable(F.col("e"))
        )
        rows = usable_rows.select("vec_id", whole_numbers(F.col("e"), factor).alias("v"))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return rows.withColumn("length", length)

    bucket = F.when(F.col("length") > 0, F.floor(F.log("length") / float(np.log(LENGTH_STEP)))).otherwise(F.lit(-(10**6)))
    all_rows = stored(whole(vectors).withColumn("bucket", bucket.cast("int")), "vectors")
    sizes = all_rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.max("length").alias("longest"), F.max(F.size("v")).alias("width")
    ).collect()  # a row per factor of 1.05 in length, at most some 30,000 for all doubles
    asked = whole(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.max_by("v", "v").alias("q"), F.max("length").alias("q_length"))
    asked = stored(asked, "queries")
    n_asked = asked.count()
    empty = asked.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.col("query_id").alias("score")).limit(0)
    if not sizes or not n_asked:
        return empty
    width = max(r["width"] for r in sizes)
    n_parts = -(-n_asked // part_queries)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_parts)).cast("int"))
    table, seeds, rows_seen = [], [], 0
    for r in sorted(sizes, key=lambda r: -r["longest"]):
        n_blocks = -(-r["n"] // block_vectors)
        for block in range(n_blocks):
            seed = rows_seen <= 2 * k
            rows_seen += r["n"] // n_blocks
            table.append((r["bucket"], block, float(r["longest"]), seed))
    spark = vectors.sparkSession
    blocks = spark.createDataFrame(table, "bucket int, block int, longest double, seed boolean")
    in_blocks = spark.createDataFrame([(r["bucket"], -(-r["n"] // block_vectors)) for r in sizes], "bucket int, n_blocks int")
    placed = all_rows.join(in_blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int"))

    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = _meet(asked.withColumn("bound", F.lit(None).cast("bigint")), placed, blocks.where("seed"), n_parts, k, width)
    first = stored(first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).drop("rank"), "first")
    bounds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    bounds = bounds.select("query_id", F.when(F.col("n") >= k, F.col("low")).alias("bound"))
    rest = _meet(asked.join(bounds, "query_id", "left"), placed, blocks.where("not seed"), n_parts, k, width)
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Approximate nearest neighbours by a clustered index whose recall is measured, not assumed.

Centres come from a bounded sample, every row of the corpus is placed with its nearest centre, and a query visits the
clusters whose centres are nearest to it. How many it visits is chosen from exact answers (``retrieval``) to a sample of
queries: the least number that reaches the wanted recall. Within the visited clusters the search is exact, by the same
blocks as the full search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from citeflow.functions.hashing import seeded_hash
from citeflow.operators.ranking import topk_per_group
from citeflow.operators.retrieval import BLOCK_BYTES, FEW_QUERIES, blocked_topk, blocks_of, matrix, search_block, top_lists
from citeflow.session import stored

#: Bounds, all of them parameters: vectors the centres are fitted on (and their bytes), rows of the sample per centre,
#: rounds of fitting, and queries whose exact neighbours tell the recall.
SAMPLE_ROWS, SAMPLE_BYTES, ROWS_A_CENTRE, ROUNDS = 20_000, 64 * 1024 * 1024, 40, 10
SAMPLE_QUERIES = 500


@dataclass(frozen=True)
class ClusterIndex:
    """``rows``: ``cand_id, vec, cluster, slice`` of the whole corpus; ``centres``: one unit vector a line; ``slices``: into
    how many the rows of each cluster are cut; ``sizes``: how many rows it has; ``slice_rows``: rows wanted in a slice."""

    rows: DataFrame
    centres: np.ndarray
    slices: dict[int, int]
    sizes: dict[int, int]
    slice_rows: int


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def fit_centres(sample: np.ndarray, centres: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from the first rows of the sample, which is in the order of a hash; the same on every run."""
    sample = _unit(sample.astype(np.float64))
    if len(sample) == 0:
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    middle = sample[:centres].copy()
    for _ in range(rounds):
        nearest = np.argmax(sample @ middle.T, axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, nearest, sample)
        used = np.abs(sums).sum(axis=1) > 0
        middle[used] = _unit(sums[used])
    return middle


def nearest_centres(vec: Column, centres: np.ndarray, n: int) -> Column:
    """The ``n`` nearest centres of each vector, best first, as an array of their numbers."""
    import pyarrow as pa

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            kept = min(n, len(centres))
            found = np.zeros((len(batch), kept), dtype=np.int32)
            m = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1) if len(batch) else found
            for at in range(0, len(batch) if centres.any() else 0, 4096):
                near = _unit(m[at : at + 4096]) @ centres.T
                found[at : at + 4096] = np.argsort(-near, axis=1, kind="stable")[:, :kept]
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * kept
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

    place.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(place, "array<int>").asNondeterministic()(vec)


def build_index(corpus: DataFrame, seed: int = 42, sample_rows: int = SAMPLE_ROWS, slice_rows: int | None = None, centres: int | None = None) -> ClusterIndex:
    """Place every row of ``corpus`` (``cand_id, vec``); vectors must not be null.

    The centres are fitted on at most ``sample_rows`` rows, and at most ``SAMPLE_BYTES``, chosen by a hash of the id; by
    default as many as the square root of the number of rows, but a 40th of the sample at most. A cluster of more than
    ``slice_rows`` rows is cut into slices, so a hot cluster is no large task.
    """
    rows = corpus.count()
    head = corpus.select(F.size("vec").alias("dim")).first()
    dim = max(1, head["dim"] if head else 1)
    bound = min(sample_rows, SAMPLE_BYTES // (8 * dim))
    share = min(1.0, 1.5 * bound / max(rows, 1))
    place = F.xxhash64(F.lit(seed), "cand_id")
    chosen = corpus.where(F.pmod(place, F.lit(1 << 30)) <= share * (1 << 30)).orderBy(seeded_hash(seed, "cand_id"), "cand_id").limit(bound)
    sample = chosen.select("vec").toArrow()["vec"].combine_chunks()
    flat = sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1) if len(sample) else np.zeros((0, dim))
    wanted = centres or max(1, min(round(rows**0.5), len(flat) // ROWS_A_CENTRE))
    middle = fit_centres(flat, wanted)
    placed = corpus.select("cand_id", "vec", nearest_centres(F.col("vec"), middle, 1)[0].alias("cluster"))
    slice_rows = slice_rows or max(1, BLOCK_BYTES // (8 * dim))
    placed = stored(placed, "placed")
    sizes = {r["cluster"]: r["n"] for r in placed.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # a row per centre
    slices = {c: -(-n // slice_rows) for c, n in sizes.items()}
    cut = F.pmod(F.xxhash64("cand_id"), _per_cluster(F.col("cluster"), slices)).cast("int")
    return ClusterIndex(placed.withColumn("slice", cut), middle, slices, sizes, slice_rows)


def _per_cluster(cluster: Column, values: dict[int, int]) -> Column:
    """A number of each cluster, 0 by default: a literal array over the centres, of which there are few."""
    listed = F.lit([values.get(c, 0) for c in range(max(values, default=0) + 1)])
    return F.coalesce(F.get(listed, cluster), F.lit(0))


def _unit_of(index: ClusterIndex, cluster: Column, slice_: Column, units: int) -> Column:
    """The unit a slice of a cluster is searched in: slices in order, cut into units of about as many rows."""
    begins = dict(zip(sorted(index.sizes), np.cumsum([0, *(index.sizes[c] for c in sorted(index.sizes))]).tolist()))
    within = F.expr("bigint(0)") + slice_ * _per_cluster(cluster, index.sizes)
    begin = _per_cluster(cluster, begins) + F.floor(within / F.greatest(_per_cluster(cluster, index.slices), F.lit(1)))
    return F.floor(begin * units / max(1, sum(index.sizes.values()))).cast("int")


def _visitor(k: int, digits: int | None, id_type, query_type) -> Callable:
    def scan(queries, corpus):
        import pyarrow as pa
        import pyarrow.compute as pc

        corpus = corpus.take(pc.sort_indices(corpus, sort_keys=[("cand_id", "ascending")]))
        left, right = matrix(queries["vec"]), matrix(corpus["vec"])
        visited, cluster, groups = queries["visits"].combine_chunks(), corpus["cluster"].to_numpy(), None
        if visited.null_count < len(visited):
            asker = np.repeat(np.arange(len(left)), pc.list_value_length(visited).to_numpy())
            wanted = visited.flatten().to_numpy()
            askers, members = np.argsort(wanted, kind="stable"), np.argsort(cluster, kind="stable")
            wanted, cluster = wanted[askers], cluster[members]
            part = lambda order, keys, c: order[np.searchsorted(keys, c, "left") : np.searchsorted(keys, c, "right")]
            groups = [(asker[part(askers, wanted, c)], part(members, cluster, c)) for c in np.intersect1d(wanted, cluster)]
        best = search_block(left, right, k, digits, groups)
        top = top_lists(best, corpus["cand_id"].to_numpy(), id_type)
        return pa.table({"query_id": queries["query_id"].cast(query_type), "top": top})

    return scan


def search_index(index: ClusterIndex, queries: DataFrame, k: int, probes: int, digits: int | None = 6, block_rows: int | None = None) -> DataFrame:
    """The ``k`` nearest rows within the ``probes`` nearest clusters of every query: ``query_id, cand_id, score, rank``.

    Slices lie together in units of about a block. A unit meets the queries that visit it in blocks, one task each, which
    compares each query with the clusters it visits; a query goes once to a unit, however many clusters it visits there.
    With as many probes as centres the answer is the exact one. Empty clusters are never visited.
    """
    id_type, query_type = index.rows.schema["cand_id"].dataType, queries.schema["query_id"].dataType
    most = max(FEW_QUERIES, BLOCK_BYTES // (8 * index.centres.shape[1]))
    blocks = max(1, blocks_of(queries.count(), block_rows or max(FEW_QUERIES, most // 16), most))
    units = max(1, blocks_of(sum(index.sizes.values()), min(index.slice_rows, max(FEW_QUERIES, most // 16)), most))
    place = lambda cluster, slice_: _unit_of(index, cluster, slice_, units)
    if probes >= len(index.centres):
        visits = queries.select("query_id", "vec", F.lit(None).cast("array<int>").alias("visits"), F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"))
    else:
        first = lambda c: place(c, F.lit(0))
        last = lambda c: place(c, _per_cluster(c, index.slices) - 1)
        near = F.filter(nearest_centres(F.col("vec"), index.centres, probes), lambda c: _per_cluster(c, index.sizes) > 0)
        visits = queries.select("query_id", "vec", F.transform(near, lambda c: F.struct(c.alias("c"), first(c).alias("first"), last(c).alias("last"))).alias("near"))
        reached = F.array_distinct(F.flatten(F.transform("near", lambda v: F.sequence(v["first"], v["last"]))))
        visits = visits.select("*", F.explode(reached).alias("unit"))
        here = F.filter("near", lambda v: (v["first"] <= F.col("unit")) & (F.col("unit") <= v["last"]))
        visits = visits.select("query_id", "vec", F.transform(here, lambda v: v["c"]).alias("visits"), "unit")
    visits = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    corpus = index.rows.select("cand_id", "vec", "cluster", place(F.col("cluster"), F.col("slice")).alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    scan = _visitor(k, digits, to_arrow_type(id_type), to_arrow_type(query_type))
    top = T.ArrayType(T.StructType().add("cand_id", id_type).add("score", "double").add("raw", "double"))
    schema = T.StructType().add("query_id", query_type).add("top", top)
    keys = ["unit", "block"]
    met = visits.groupBy(*keys).cogroup(corpus.groupBy(*keys)).applyInArrow(scan, schema)
    return topk_per_group(met.select("query_id", F.inline("top")).select("query_id", "cand_id", "score"), k)


def recall_by_probes(index: ClusterIndex, queries: DataFrame, corpus: DataFrame, k: int) -> list[float]:
    """Share of the exact ``k`` nearest rows that lie in the 1, 2, .. nearest clusters of the given queries."""
    exact = blocked_topk(queries, corpus, k).select("query_id", "cand_id")
    where = exact.join(index.rows.select("cand_id", "cluster"), "cand_id")
    order = queries.select("query_id", nearest_centres(F.col("vec"), index.centres, len(index.centres)).alias("order"))
    placed = where.join(order, "query_id").select(F.array_position("order", F.col("cluster")).alias("probe"))
    counts = {r["probe"]: r["n"] for r in placed.groupBy("probe").agg(F.count("*").alias("n")).collect()}  # a row per centre
    found = np.cumsum([counts.get(p, 0) for p in range(1, len(index.centres) + 1)])
    return (found / max(1, found[-1])).tolist()


def probes_for(recalls: list[float], target: float) -> int:
    """The least number of clusters to visit for the wanted recall."""
    return next((p for p, r in enumerate(recalls, 1) if r >= target), len(recalls))


def approximate_topk(
    queries: DataFrame, corpus: DataFrame, k: int, target: float = 0.9, seed: int = 42, sample_queries: int = SAMPLE_QUERIES, index: ClusterIndex | None = None
) -> tuple[DataFrame, int]:
    """The ``k`` nearest rows by the index, visiting as many clusters as the wanted recall takes, and that number.

    The recall is measured against exact answers on at most ``sample_queries`` of the queries, chosen by a hash.
    """
    index = index or build_index(corpus, seed)
    some = stored(queries.orderBy(seeded_hash(seed, "query_id"), "query_id").limit(sample_queries), "asked")
    probes = probes_for(recall_by_probes(index, some, corpus, k), target)
    return search_index(index, queries, k, probes), probes

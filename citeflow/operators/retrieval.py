"""Exact nearest neighbours by blocks: every query against the whole corpus, without a row per pair.

Queries and corpus are cut into blocks of about ``BLOCK_BYTES`` by a hash of their id or vector, each pair of blocks meets in one
task, and the task multiplies two matrices. Out of it come, per query and corpus block, only the local best ``k``,
the number of candidates ahead of the right one, and what a softmax needs. So a task's memory depends on the block size
alone, the work is spread evenly whatever the data, and what is shuffled afterwards is ``queries * corpus blocks`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from citeflow.functions.vectors import dot
from citeflow.operators.joins import join_spread
from citeflow.operators.numbering import HOT_ROWS, count_groups, hot_groups, join_bounded
from citeflow.operators.ranking import topk_per_group

# what one block of widened vectors may take in a task, and the fewest queries worth a block of their own
BLOCK_BYTES = 32 * 1024 * 1024
FEW_QUERIES = 256
# so many blocks of a side at most are cut to a wanted number of rows: every vector is copied once per block of the other side
MANY_BLOCKS = 16
# pairs of blocks for each core, so that some of more work even out
BLOCKS_A_CORE = 8
# copies of one vector that lie in one block, at most about so many
COPIES = 4096
# similarities held at once inside a task, and columns of the first tile, which tells where the best begin
TILE_ROWS, TILE_COLS, FIRST_COLS = 512, 2048, 512
#: Unrounded similarities this close are ties: the right candidate's comes from Spark, the others' from a matrix product,
#: and the two may differ in their last bits.
TIE = 1e-12


def matrix(column) -> np.ndarray:
    """A column of vectors as rows of length one, widened."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    m /= np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-12)[:, None]  # in place: a block is held once
    return m


def _products(left: np.ndarray, right: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Similarities of the given cells, in full precision."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("ij,ij->i", left[rows[part]], right[cols[part]])
    return out


def _narrow_error(dim: int) -> float:
    """How far a product of two unit vectors may be off when it is computed in single precision."""
    return 1.01 * (dim + 4) * 2.0**-24


def _tiles(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Single-precision products, tile by tile, all columns of some rows before the next rows: first row, first column, and
    the products in memory that the next tile takes again. The first columns come in a narrow tile."""
    room = np.empty(TILE_ROWS * TILE_COLS, dtype=np.float32)
    left, right = left.astype(np.float32), np.ascontiguousarray(right.astype(np.float32).T)
    for row in range(0, len(left), TILE_ROWS):
        some, col = left[row : row + TILE_ROWS], 0
        while col < right.shape[1]:
            part = right[:, col : col + (TILE_COLS if col else FIRST_COLS)]
            shape = (len(some), part.shape[1])
            yield row, col, np.matmul(some, part, out=room[: shape[0] * shape[1]].reshape(shape))
            col += shape[1]


class Best:
    """The best ``k`` columns found so far for each row: ``at`` (column, -1 where there are fewer), ``score``, ``raw``."""

    def __init__(self, rows: int, k: int):
        self.at = np.full((rows, k), -1, dtype=np.int64)
        self.score, self.raw = np.full((rows, k), -np.inf), np.full((rows, k), -np.inf)

    def offer(self, rows: np.ndarray, at: np.ndarray, raw: np.ndarray, score: np.ndarray) -> None:
        some, place = np.unique(rows, return_inverse=True)
        have = self.at[some] >= 0
        rows = np.concatenate([np.nonzero(have)[0], place])
        at, score = np.concatenate([self.at[some][have], at]), np.concatenate([self.score[some][have], score])
        raw = np.concatenate([self.raw[some][have], raw])
        order = np.lexsort((at, -score, rows))
        rows = rows[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        order, rows, rank = (x[rank < self.at.shape[1]] for x in (order, rows, rank))
        self.at[some[rows], rank], self.score[some[rows], rank], self.raw[some[rows], rank] = at[order], score[order], raw[order]


def search_block(left: np.ndarray, right: np.ndarray, k: int, digits: int | None, groups: list[tuple[np.ndarray, np.ndarray]] | None = None) -> Best:
    """The best ``k`` rows of ``right``, which is in the order of its ids, for every row of ``left``.

    ``groups`` restricts the search: rows of ``left`` and, ascending, the rows of ``right`` they are compared with; of one
    row of ``left`` no group has a row of ``right`` again. Products are made in single precision; where these cannot rule
    a row out, they are made again in full.
    """
    best = Best(len(left), k)
    if k == 0:
        return best
    error, half = _narrow_error(left.shape[1]), 0.0 if digits is None else 0.5 * 10.0**-digits
    every = groups is None
    for mine, theirs in [(np.arange(len(left)), np.arange(len(right)))] if every else groups:
        for row, col, near in _tiles(left[mine], right[theirs]):
            rows = mine[row : row + TILE_ROWS]
            least = best.score[rows, k - 1]
            # in the order of ids, a later row must be better than the last of a full list; else it may be as good
            cut = least + (half if every else -half) - error - TIE
            if near.shape[1] > k and np.isneginf(cut).any():
                edge = near.shape[1] - k
                cut = np.maximum(cut, np.partition(near, edge, axis=1)[:, edge] - 2 * (half + error + TIE))
            hit = np.flatnonzero(near >= np.nextafter(cut.astype(np.float32), np.float32(-np.inf))[:, None])
            if len(hit):
                r, c = rows[hit // near.shape[1]], theirs[col + hit % near.shape[1]]
                raw = _products(left, right, r, c)
                best.offer(r, c, raw, raw if digits is None else np.round(raw, digits))
    return best


def _merged(right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows once, those with the most copies first; how many copies each has, and the place of every row's own."""
    n, bits = len(right), np.ascontiguousarray(right).view(np.uint64)
    mix = np.random.default_rng(0).integers(1, 1 << 63, right.shape[1], dtype=np.uint64)
    digest = np.einsum("ij,j->i", bits, mix)  # wraps around
    order = np.argsort(digest, kind="stable")
    alike = np.flatnonzero(digest[order[1:]] == digest[order[:-1]])
    new = np.ones(n, dtype=bool)
    for at in range(0, len(alike), 1 << 12):
        some = alike[at : at + (1 << 12)]
        new[some + 1] = (bits[order[some]] != bits[order[some + 1]]).any(axis=1)
    if new.all():
        return right, np.ones(n, dtype=np.int64), np.arange(n)
    of = np.cumsum(new) - 1
    copies = np.bincount(of)
    most = np.argsort(-copies, kind="stable")
    place, group = np.empty_like(most), np.empty(n, dtype=np.int64)
    place[most] = np.arange(len(most))
    group[order] = place[of]
    return right[order[new][most]], copies[most], group


def _cells(of: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A range of ``of`` for each row as cells, some at a time: row and what ``of`` has there."""
    ends = np.cumsum(end - start)
    for at in range(0, int(ends[-1]), 1 << 20):
        cell = np.arange(at, min(at + (1 << 20), ends[-1]))
        row = np.searchsorted(ends, cell, "right")
        yield row, of[end[row] - (ends[row] - cell)]


def _marked(flags: np.ndarray) -> np.ndarray:
    """Where the flags are set, of which few are: eight are looked at at once."""
    flat = flags.reshape(-1)
    whole = len(flat) & ~7
    at = np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)
    at = np.concatenate([at.ravel(), np.arange(whole, len(flat))])
    return at[flat[at]]


def count_ahead(left: np.ndarray, right: np.ndarray, limit: np.ndarray, before: np.ndarray, upto: np.ndarray, digits: int | None) -> np.ndarray:
    """How many rows of ``right`` are ahead of the right one, whose similarity is ``limit`` and whose place in the order of
    ids is from ``before`` to ``upto``; these themselves do not count. A ``limit`` of nan has none ahead. Equal rows are
    multiplied once and count as often as they occur."""
    ahead = np.zeros(len(left), dtype=np.int64)
    n = len(right)
    right, copies, group = _merged(right)
    # the copies of each row in the order of ids, to count those below a place
    placed, first = np.sort(group * n + np.arange(n)), np.cumsum(copies) - copies
    slack = TIE if digits is None else 0.0
    margin = _narrow_error(left.shape[1]) + TIE + (slack if digits is None else 0.5 * 10.0**-digits)
    low = np.nextafter((limit - margin).astype(np.float32), np.float32(-np.inf))
    high = np.nextafter((limit + margin).astype(np.float32), np.float32(np.inf))
    rooms = [np.empty(TILE_ROWS * TILE_COLS, dtype=bool) for _ in range(2)]
    for row, col, near in _tiles(left, right):
        part, width = slice(row, row + len(near)), near.shape[1]
        sure, doubt = (room[: near.size].reshape(near.shape) for room in rooms)
        np.greater(near, high[part, None], out=sure)
        times = copies[col : col + width]
        if times[0] != times[-1]:
            ahead[part] += sure @ times
        else:  # a flag is a byte of 0 or 1, so eight of them are counted at once
            ahead[part] += times[0] * (sure.sum(axis=1) if width % 8 else np.bitwise_count(sure.view(np.uint64)).sum(axis=1, dtype=np.int64))
        for r, c in _cells(group, before[part], upto[part]):
            here = (c >= col) & (c < col + width)
            r, c = r[here], c[here] - col
            ahead[part] -= np.bincount(r[sure[r, c]], minlength=len(near))
        np.greater_equal(near, low[part, None], out=doubt)
        doubtful = _marked(np.not_equal(doubt, sure, out=doubt))
        r, c = row + doubtful // width, col + doubtful % width
        raw = _products(left, right, r, c)
        sim = raw if digits is None else np.round(raw, digits)
        earlier, own = (np.searchsorted(placed, c * n + edge[r]) - first[c] for edge in (before, upto))
        own = own - earlier
        front = np.where(sim > limit[r] + slack, copies[c] - own, np.where(np.abs(sim - limit[r]) <= slack, earlier, 0))
        np.add.at(ahead, r, front)
    return ahead


def _softmax_parts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest similarity of each row of ``left`` and the sum of the exponentials of all, relative to it."""
    peak, mass = np.full(len(left), -np.inf), np.zeros(len(left))
    step = max(1, TILE_ROWS * TILE_COLS // max(1, len(right)))
    for at in range(0, len(left) if len(right) else 0, step):
        raw = left[at : at + step] @ right.T
        peak[at : at + step] = raw.max(axis=1)
        mass[at : at + step] = np.exp(raw - peak[at : at + step, None]).sum(axis=1)
    return peak, mass


def top_lists(best: Best, cand, id_type):
    """The best of each row as a list of ``cand_id, score, raw``; ``cand`` has the ids of the columns."""
    import pyarrow as pa

    found = best.at >= 0
    names = pa.array(cand[best.at[found]], id_type) if len(cand) else pa.array([], id_type)
    top = pa.StructArray.from_arrays([names, pa.array(best.score[found]), pa.array(best.raw[found])], names=["cand_id", "score", "raw"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(found.sum(axis=1))), pa.int32()), top)


def _scanner(k: int, digits: int | None, id_type, softmax: bool) -> Callable:
    def scan(queries, corpus):
        import pyarrow as pa
        import pyarrow.compute as pc

        # in the order of ids, so that ties are broken by place
        corpus = corpus.take(pc.sort_indices(corpus, sort_keys=[("cand_id", "ascending")]))
        cand = corpus["cand_id"].to_numpy()
        left, right = matrix(queries["vec"]), matrix(corpus["vec"])
        n, m = len(left), len(right)
        best, mass = _softmax_parts(left, right) if softmax else (np.full(n, -np.inf), np.zeros(n))
        known = pc.is_valid(queries["truth_score"]).to_numpy()
        ahead = np.zeros(n, dtype=np.int64)
        if m and known.any():
            some = np.flatnonzero(known)
            truth_known = pc.is_valid(queries["truth_id"]).to_numpy()[some]
            truth = queries["truth_id"].fill_null(corpus["cand_id"][0]).to_numpy().astype(cand.dtype)[some]
            places = [np.where(truth_known, np.searchsorted(cand, truth, side), 0) for side in ("left", "right")]
            ahead[some] = count_ahead(left[some], right, queries["truth_score"].to_numpy().astype(np.float64)[some], *places, digits)
        found = search_block(left, right, k, digits) if n and m else Best(n, k)
        return pa.table(
            {
                "query_id": queries["query_id"],
                "best": pa.array(best, pa.float64()),
                "mass": pa.array(mass, pa.float64()),
                "ahead": pa.array(ahead, pa.int64(), mask=~known),  # without a right candidate null
                "top": top_lists(found, cand, id_type),
            }
        )

    return scan


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _dealt(corpus: DataFrame, blocks: int) -> DataFrame:
    """The corpus with its block ``_bc``: copies of a vector lie in one block, where they are multiplied once. Of a vector
    with more copies than a small part of a block, slices do."""
    if blocks == 1:
        return corpus.withColumn("_bc", F.lit(0))
    keyed = corpus.withColumn("_vec", F.xxhash64("vec"))
    hot = hot_groups(count_groups(keyed, ["_vec"]), COPIES)
    if hot is None:
        return keyed.withColumn("_bc", F.pmod("_vec", F.lit(blocks)).cast("int")).drop("_vec")
    sliced = join_bounded(keyed, hot, ["_vec"]).withColumn("_slice", F.coalesce(F.pmod(F.xxhash64("cand_id"), "_slices"), F.lit(0)))
    return sliced.withColumn("_bc", F.pmod(F.xxhash64("_vec", "_slice"), F.lit(blocks)).cast("int")).drop("_vec", "_n", "_slices", "_slice")


def _block_counts(queries: DataFrame, corpus: DataFrame, block_rows: int | None) -> tuple[int, int]:
    """Into how many blocks to cut the two sides.

    Large blocks mean few copies of each vector; with little data the queries are cut further so that all cores work.
    ``block_rows`` cuts finer, up to ``MANY_BLOCKS`` blocks a side.
    """
    n_queries, n_corpus = queries.count(), corpus.count()
    first = corpus.select(F.size("vec").alias("dim")).where(F.col("dim") > 0).first()
    rows = max(FEW_QUERIES, BLOCK_BYTES // (8 * (first["dim"] if first else 1)))
    if block_rows:
        return tuple(max(1, blocks_of(n, block_rows, rows)) for n in (n_queries, n_corpus))
    corpus_blocks = max(1, -(-n_corpus // rows))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    for_cores = min(-(-cores // corpus_blocks), -(-n_queries // FEW_QUERIES))
    evened = min(-(-BLOCKS_A_CORE * cores // corpus_blocks), n_queries // (4 * FEW_QUERIES))
    return max(1, -(-n_queries // rows), for_cores, evened), corpus_blocks


def blocks_of(n: int, wanted: int, most: int) -> int:
    """Blocks of ``wanted`` rows, or, where these are more than ``MANY_BLOCKS``, so many of up to ``most`` rows: with blocks of
    a fixed number of rows the pairs of blocks and the copies of each vector would grow with the square of the data."""
    return min(-(-n // wanted), max(MANY_BLOCKS, -(-n // most)))


def scan_blocks(
    queries: DataFrame, corpus: DataFrame, k: int, digits: int | None = 6, block_rows: int | None = None, counted: DataFrame | None = None, softmax: bool = True
) -> DataFrame:
    """Per query and corpus block: ``top`` (best ``k``), ``ahead`` (candidates before the right one), ``best``, ``mass``.

    ``queries`` has ``query_id, vec`` and, where ranks are wanted, ``truth_id, truth_score``; ``corpus`` has
    ``cand_id, vec``. Vectors stay as they are stored until a task widens and normalises them. ``counted`` is a frame
    with as many rows as ``queries`` that is cheaper to count. ``block_rows`` makes blocks smaller while they are few. Without
    ``softmax``, ``best`` and ``mass`` are not made, and most cells are decided in single precision. Where ranks are wanted,
    copies of a vector lie in one block.
    """
    id_type = corpus.schema["cand_id"].dataType
    ranked = "truth_id" in queries.columns
    if not ranked:
        queries = queries.withColumns({"truth_id": F.lit(None).cast(id_type), "truth_score": F.lit(None).cast("double")})
    n_queries, n_corpus = _block_counts(queries if counted is None else counted, corpus, block_rows)
    missing = F.raise_error(F.lit("a vector is null; leave its row out before the search"))
    vector = F.when(F.col("vec").isNotNull(), F.col("vec")).otherwise(missing).alias("vec")
    left = queries.select(
        "query_id",
        vector,
        "truth_id",
        "truth_score",
        _block("query_id", n_queries).alias("_bq"),
        F.explode(F.sequence(F.lit(0), F.lit(n_corpus - 1))).alias("_bc"),
    )
    dealt = _dealt(corpus, n_corpus) if ranked else corpus.withColumn("_bc", _block("cand_id", n_corpus))
    right = dealt.select("cand_id", vector, F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("_bq"), "_bc")
    query_type = queries.schema["query_id"].dataType
    top = T.StructType().add("cand_id", id_type).add("score", "double").add("raw", "double")
    schema = (
        T.StructType()
        .add("query_id", query_type)
        .add("best", "double")
        .add("mass", "double")
        .add("ahead", "long")
        .add("top", T.ArrayType(top))
    )
    scan = _scanner(k, digits, to_arrow_type(id_type), softmax)
    return left.groupBy("_bq", "_bc").cogroup(right.groupBy("_bq", "_bc")).applyInArrow(scan, schema)


def blocked_topk(queries: DataFrame, corpus: DataFrame, k: int, digits: int | None = 6, block_rows: int | None = None) -> DataFrame:
    """The ``k`` nearest corpus rows of every query by cosine: ``query_id, cand_id, score, rank``."""
    local = scan_blocks(queries, corpus, k, digits, block_rows, softmax=False).select("query_id", F.inline("top"))
    return topk_per_group(local.select("query_id", "cand_id", "score"), k)


def blocked_softmax(queries: DataFrame, corpus: DataFrame, k: int, digits: int | None = 6, block_rows: int | None = None) -> DataFrame:
    """The ``k`` best candidates with their softmax probability over **all** candidates."""
    query = Window.partitionBy("query_id")
    scanned = scan_blocks(queries, corpus, k, digits, block_rows).withColumn("_peak", F.max("best").over(query))
    scanned = scanned.withColumn("_total", F.sum(F.col("mass") * F.exp(F.col("best") - F.col("_peak"))).over(query))
    local = scanned.select("query_id", "_peak", "_total", F.inline("top"))
    prob = F.exp(F.col("raw") - F.col("_peak")) / F.col("_total")
    return topk_per_group(local.select("query_id", "cand_id", "score", prob.alias("prob")), k)


def with_truth(queries: DataFrame, corpus: DataFrame, truth: DataFrame, digits: int | None = 6, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``truth_id`` and its similarity ``truth_score`` to the queries (null where the corpus lacks it)."""
    named = queries.join(truth, "query_id", "left")
    right = corpus.select(F.col("cand_id").alias("truth_id"), F.col("vec").alias("_right"))
    found = join_spread(named, right, "truth_id", "left", hot_rows=hot_rows, salt=F.xxhash64("query_id"))
    length = F.greatest(F.sqrt(dot(F.col("vec"), F.col("vec"))), F.lit(1e-12)) * F.greatest(
        F.sqrt(dot(F.col("_right"), F.col("_right"))), F.lit(1e-12)
    )
    cosine = dot(F.col("vec"), F.col("_right")) / length
    return found.withColumn("truth_score", cosine if digits is None else F.round(cosine, digits)).drop("_right")


def retrieval_ranks(queries: DataFrame, corpus: DataFrame, truth: DataFrame, digits: int | None = 6, block_rows: int | None = None) -> DataFrame:
    """Rank of the right candidate of every query among the whole corpus, -1 where the corpus lacks it."""
    scanned = scan_blocks(with_truth(queries, corpus, truth, digits), corpus, 0, digits, block_rows, counted=queries, softmax=False)
    return scanned.groupBy("query_id").agg(_rank(F.sum("ahead")).alias("rank"))


def _rank(ahead: Column) -> Column:
    return F.coalesce(ahead + 1, F.lit(-1).cast("bigint"))


def retrieval_report(
    queries: DataFrame, corpus: DataFrame, truth: DataFrame, k: int = 3, digits: int | None = 6, block_rows: int | None = None
) -> DataFrame:
    """For a few queries: rank and similarity of the right passage, and the ``k`` nearest with a hit marker.

    ``queries`` also has ``text``, ``corpus`` also has ``text``; previews are cut at 200 and 150 characters.
    """
    asked = with_truth(queries, corpus, truth, digits)
    scanned = scan_blocks(asked, corpus, k, digits, block_rows, counted=queries, softmax=False)
    ranked = scanned.withColumn("truth_rank", _rank(F.sum("ahead").over(Window.partitionBy("query_id"))))
    local = ranked.select("query_id", "truth_rank", F.inline("top")).drop("raw")
    questions = asked.select("query_id", F.substring("text", 1, 200).alias("query_preview"), "truth_id", "truth_score")
    passages = corpus.select("cand_id", F.substring("text", 1, 150).alias("passage_preview"))
    return (
        topk_per_group(local, k)
        .join(questions, "query_id")
        .join(passages, "cand_id", "left")
        .select(
            "query_id",
            "query_preview",
            "truth_rank",
            "truth_score",
            F.col("rank").cast("bigint").alias("position"),
            "cand_id",
            "score",
            (F.col("cand_id") == F.col("truth_id")).alias("hit"),
            "passage_preview",
        )
    )

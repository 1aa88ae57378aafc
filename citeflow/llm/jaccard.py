"""Exact Jaccard self-join of word-shingle sets by universe partition and pigeonhole; classes instead of pairs.

Sets of similar size share a band. A band fixes how far two similar sets may differ (their symmetric difference H) and
hashes all shingles into segments. Every segment gets credits: 0 (not indexed), 1 (equal subsets are found) or 2
(subsets that differ by one element are found, through the one-deletion neighbourhood). When the credits exceed H, two
similar sets must be found in some segment. Which segments get credits is decided by their cost, counted over all sets:
rows to shuffle and collisions to look into. A few credits are spare: for these a set leaves out its most frequent
subsets, which would chain unlike sets together. Sets that meet in a segment are compared exactly, in bounded blocks.

Equal sets are one node from the start. Sets that meet are joined into candidate groups through the smallest node of
each subset, never by listing pairs; parity sketches split the groups further, without losing a link, before texts are
compared; each comparison reports only what connects something new. Two sets are told apart by 64-bit hashes of
shingles and of sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeflow.llm.arrays import SLICE_BYTES, Words, mix, shingle_hashes, text_slices
from citeflow.llm.components import connected_components
from citeflow.llm.frames import by_batch, col, free_name, give_back, stored

#: Sizes in a band lie within this factor (before the partners of its largest sets are added).
BAND_STEP = 1.4
#: One-deletion neighbourhoods are made in bands of sets up to this size. Beyond it one more credit costs a row per
#: element of the segment, where one more segment costs one row, so the allocation would never pick them.
DELETION_SIZE = 64
#: Credits at most by which a band has more than it needs: for so many a set may leave out its most frequent subsets.
SPARE = 12
#: What a collision costs, in rows: it may lead to an exact comparison.
COLLISION_COST = 20.0
#: Shingles that meet in one comparison task from each side (four times as many where sketches stand for them).
BLOCK_SHINGLES = 1 << 20
#: Sets of a block at most, about: their pairs are what a task compares.
BLOCK_SETS = 4096
#: A bit filter of this many bits at most goes to the executors; with more to filter the join does without it.
FILTER_BITS = 1 << 28


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    differ: int
    spare: int
    segments: int


def bands_up_to(size: int, num: int, den: int) -> list[Band]:
    """Bands until all sets of ``size`` have theirs. Of two similar sets the smaller one's home band holds both.

    A set of x elements and a larger one that share num/den of their union differ in at most (den - num) * x / num
    elements. Bands where this is 0 are left out: different sets cannot be similar there.
    """
    bands, low, number = [], 1, 0
    while low <= size:
        top = max(low, math.ceil(low * BAND_STEP) - 1)
        differ = (den - num) * top // num
        if differ:
            spare = min(SPARE, differ // 4)
            segments = differ + 1 + spare + math.ceil(differ / 16)
            bands.append(Band(number, low, top * den // num, differ, spare, segments))
        low, number = top + 1, number + 1
    return bands


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def set_digest(shingles: np.ndarray) -> int:
    return int(np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) ^ np.uint64(len(shingles)))


def signatures(shingles: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per segment the hash of the set's subset there (0: empty); for small bands per element its segment and the hash
    of the subset without it (0: empty)."""
    own = mix(shingles + np.uint64(band.number * 0x9E3779B97F4A7C15 % (1 << 64)))
    segment = (((own >> np.uint64(32)) * np.uint64(band.segments)) >> np.uint64(32)).astype(np.int64)
    value = mix(own)
    sums = np.zeros(band.segments, dtype=np.uint64)
    np.add.at(sums, segment, value)
    sizes = np.bincount(segment, minlength=band.segments)
    salt = mix(np.arange(band.segments, dtype=np.uint64) + np.uint64((band.number + 1) << 32))
    keys = np.where(sizes > 0, mix(sums ^ salt) | np.uint64(1), np.uint64(0))
    if band.high > DELETION_SIZE:
        return keys, segment[:0], keys[:0]
    less = np.where(sizes[segment] > 1, mix((sums[segment] - value) ^ salt[segment]) | np.uint64(1), np.uint64(0))
    return keys, segment, less


def parity_sketch(shingles: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words; a bit tells whether an odd number of elements fell on it. Bits in which two sketches
    differ never outnumber the elements in which the sets differ."""
    bits = (mix(shingles) % np.uint64(64 * words)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=64 * words).astype(np.uint8) & 1).view(np.uint64)


def sketch_words(size: int) -> int:
    """About two bits per element of a set of this size."""
    return 1 << max(2, math.ceil(math.log2(max(size, 1) / 32 + 1)))


_SETS = "n bigint, node bigint, band int, first boolean, sketch binary, subsets array<bigint>, of array<int>, less array<bigint>"


def index_sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """A row per document (``id``) and band: set size, set digest ``node``, subset hashes and one-deletion hashes."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands: list[Band] = []
        for batch in batches:
            ids = batch.column(0)
            for row, offsets, data in text_slices(batch.column(1), SLICE_BYTES):
                words = Words(offsets, data)
                shingles, at = shingle_hashes(words.hashes(), words.begins, n)
                sizes = np.diff(at)
                if len(sizes) and (not bands or sizes.max() > bands[-1].high // 2):
                    bands = bands_up_to(max(64, 2 * int(sizes.max())), num, den)
                take, size, node, number, first, sketch = [], [], [], [], [], []
                columns: list[list[np.ndarray]] = [[], [], []]
                for k in range(len(sizes)):
                    some = shingles[at[k] : at[k + 1]]
                    digest = set_digest(some)
                    mine = [b for b in bands if b.low <= len(some) <= b.high]
                    for j, band in enumerate(mine or [None]):
                        made = signatures(some, band) if band else (shingles[:0], at[:0], shingles[:0])
                        for column, part in zip(columns, made, strict=True):
                            column.append(part)
                        take.append(row + k)
                        size.append(len(some))
                        node.append(digest)
                        number.append(band.number if band else -1)
                        first.append(j == 0)
                        sketch.append(parity_sketch(some, sketch_words(band.high)).tobytes() if band else b"")

                def nested(parts: list[np.ndarray], kind: type) -> pa.Array:
                    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                    flat = np.concatenate(parts)
                    return pa.ListArray.from_arrays(starts, pa.array(_signed(flat) if kind is np.int64 else flat.astype(kind)))

                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(take)),
                        pa.array(size, pa.int64()),
                        pa.array(_signed(np.array(node, dtype=np.uint64))),
                        pa.array(number, pa.int32()),
                        pa.array(first),
                        pa.array(sketch, pa.binary()),
                        nested(columns[0], np.int64),
                        nested(columns[1], np.int32),
                        nested(columns[2], np.int64),
                    ],
                    names=["id", "n", "node", "band", "first", "sketch", "subsets", "of", "less"],
                )

        give_back()

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, {_SETS}")


def allocate(differ: int, spare: int, costs: list[tuple[float, float]]) -> list[int]:
    """Credits (0, 1 or 2) per segment that sum to ``differ + 1 + spare`` at the least cost.

    ``costs`` has for each segment what its first credit costs and what its second costs on top.
    """
    steps = sorted([(a, i) for i, (a, _) in enumerate(costs)] + [(max(a, b), i) for i, (a, b) in enumerate(costs)])
    credits = [0] * len(costs)
    for _, i in steps[: differ + 1 + spare]:
        credits[i] += 1
    return credits


def credits_by_cost(sets: DataFrame, num: int, den: int) -> list[tuple[int, int, list[int]]]:
    """(band, spare, credits of its segments), from rows and collisions counted over all sets.

    What is collected has an entry per segment: their number grows with the largest set, not with the number of sets.
    """
    rows = {}
    parts = [
        sets.where("band >= 0").select("band", F.posexplode("subsets").alias("at", "key")),
        sets.where("size(less) > 0").select("band", F.explode(F.arrays_zip("of", "less")).alias("z")).select("band", F.col("z.of").alias("at"), F.col("z.less").alias("key")),
    ]
    for part in parts:
        counted = part.groupBy("band", "at").agg(F.count("*").alias("n"), F.approx_count_distinct("key").alias("d"))
        for r in counted.collect():
            rows.setdefault((r["band"], r["at"]), []).append(r["n"] + COLLISION_COST * max(0, r["n"] - r["d"]))
    numbers = {band for band, _ in rows}
    out = []
    for band in bands_up_to(2 * max((int(sets.agg(F.max("n")).first()[0] or 0), 1)), num, den):
        if band.number in numbers:
            costs = [(c[0], c[1] if len(c) > 1 and band.high <= DELETION_SIZE else math.inf) for c in (rows.get((band.number, i), [0.0]) for i in range(band.segments))]
            out.append((band.number, band.spare, allocate(band.differ, band.spare, costs)))
    return out


def index_rows(sets: DataFrame, credits: list[tuple[int, int, list[int]]]) -> DataFrame:
    """(``key``, ``node``, ``band``, ``credit``, ``left``): under which hashes each set is found, what the hash's segment
    counts, and how many of the spare credits are left to leave out more.

    Empty subsets, which many sets have in common, are left out of a set's rows as long as their credits do not exceed
    the spare ones: two similar sets agree on more credits than that, so they also meet elsewhere.
    """
    table = sets.sparkSession.createDataFrame(credits, "band int, spare int, credits array<int>")
    rows = sets.join(F.broadcast(table), "band")  # an entry per segment, see credits_by_cost
    given = F.transform("subsets", lambda x, i: F.struct(x.alias("key"), F.get("credits", i).alias("c"), i.alias("at")))
    less = F.transform(F.arrays_zip("of", "less"), lambda z: F.struct(z["less"].alias("key"), F.get("credits", z["of"]).alias("c"), z["of"].alias("at")))
    rows = rows.select("node", "band", "spare", F.filter(given, lambda e: e["c"] >= 1).alias("own"), F.filter(less, lambda e: e["c"] == 2).alias("less"))
    entries = F.concat("own", "less")
    hollow = F.aggregate(entries, F.lit(0), lambda a, e: a + F.when(e["key"] == 0, e["c"]).otherwise(F.lit(0)))
    rows = rows.select("node", "band", entries.alias("entries"), (F.col("spare") - hollow).alias("rest"))
    used = F.filter("entries", lambda e: (e["key"] != 0) | (F.col("rest") < 0))
    keys = F.transform(used, lambda e: F.struct(F.when(e["key"] != 0, e["key"]).otherwise(F.xxhash64("band", e["at"])).alias("key"), e["c"].cast("byte").alias("credit")))
    # a set that keeps its empty subsets leaves out nothing else, or it may miss one that leaves them out
    left = F.greatest("rest", F.lit(0)).cast("byte").alias("left")
    return rows.select("node", "band", left, F.explode(keys).alias("e")).select("e.key", "node", "band", "e.credit", "left")


def rarest(found: DataFrame) -> DataFrame:
    """(``key``, ``node``, ``band``) of ``found`` without the most frequent keys of each set, as far as its credits allow.

    All sets leave out by one order of the keys. Two similar sets agree on more credits than either may leave out, so the
    last in this order of the keys that they agree on stays with both: for all before it they have not credits enough.
    """
    often = found.groupBy("key").agg(F.count("*").alias("often"))
    ranked = Window.partitionBy("node", "band").orderBy(F.desc("often"), "key").rowsBetween(Window.unboundedPreceding, 0)
    spent = found.join(often, "key").withColumn("spent", F.sum("credit").over(ranked))
    return spent.where("spent > left").select("key", "node", "band")


def bit_filter(values: DataFrame, name: str, column: str | None = None) -> Column | None:
    """A condition on ``column`` (the same name by default) that holds for every value of a long column, and for few
    others; None when that takes too many bits.

    The bits are set by Spark's bitmap functions, 4 KB a row, and at most 32 MB of them reach the driver.
    """
    wanted = max(1 << 16, 1 << (8 * values.count()).bit_length())
    if wanted > FILTER_BITS:
        return None
    spread = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.lit(wanted))
    at = spread(F.col(name))
    counted = at + 1  # the bitmap functions count from 1
    rows = values.groupBy(F.bitmap_bucket_number(counted).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(counted)).alias("bits")
    )
    bits = np.zeros(max(wanted // 8, 4096), dtype=np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        bits[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(part)] |= part

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for positions in batches:
            p = positions.to_numpy(zero_copy_only=False)
            yield pa.array((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)

    return by_batch(run, "boolean", spread(F.col(column or name)))


def links_in_block(sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links (positions) that connect everything similar among ``sets``, or between those of different ``side``.

    Sets are taken by size. Bits of a parity sketch that differ never outnumber the elements that differ, so most
    dissimilar pairs fall out by counting bits; a pair that is connected already is not compared.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    words = min(128, sketch_words(2 * int(sizes.max(initial=1))))
    sketch = np.array([parity_sketch(sets[o], words) for o in order]).reshape(len(sets), words)
    sides = side[order] if side is not None else None
    root = np.arange(len(sets))
    links = []
    for k in range(1, len(sets)):
        at = int(np.searchsorted(sizes, -(-num * sizes[k] // den)))
        open_ = root[at:k] != root[k]
        if sides is not None:
            open_ &= sides[at:k] != sides[k]
        near = at + np.flatnonzero(open_)
        if not len(near):
            continue
        apart = np.bitwise_count(sketch[near] ^ sketch[k]).sum(axis=1, dtype=np.int64)
        near = near[apart * (den + num) <= (den - num) * (sizes[near] + sizes[k])]
        for j in near:
            if root[j] != root[k]:
                both = np.concatenate([sets[order[j]], sets[order[k]]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if den * common >= num * (sizes[j] + sizes[k] - common):
                    links.append((int(order[j]), int(order[k])))
                    root[root == root[j]] = root[k]
    return links


def _stars(links: list[tuple[int, int]], names: list[int]) -> pa.Table:
    """Each end of a link with the smallest name it is connected to."""
    low = {i: i for link in links for i in link}

    def root(i: int) -> int:
        while low[i] != i:
            low[i] = low[low[i]]
            i = low[i]
        return i

    for i, j in links:
        i, j = root(i), root(j)
        low[max(i, j, key=names.__getitem__)] = min(i, j, key=names.__getitem__)
    ends = [root(i) for i in low]
    return pa.table({"a": pa.array([names[i] for i in low], pa.int64()), "b": pa.array([names[j] for j in ends], pa.int64())})


def _alike(num: int, den: int):
    """Connects the sets of a task that their sketches do not tell apart; they are of one band."""

    def run(table: pa.Table) -> pa.Table:
        names, sizes = table["member"].to_pylist(), table["n"].to_numpy()
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order]
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint64).reshape(len(sizes), -1)[order]
        block = table["block"].to_numpy()[order]
        sides = block if len(set(block.tolist())) > 1 else None
        root, links = np.arange(len(sizes)), []
        for k in range(1, len(sizes)):
            at = int(np.searchsorted(sizes, -(-num * sizes[k] // den)))
            open_ = root[at:k] != root[k]
            if sides is not None:
                open_ &= sides[at:k] != sides[k]
            near = at + np.flatnonzero(open_)
            apart = np.bitwise_count(sketch[near] ^ sketch[k]).sum(axis=1, dtype=np.int64)
            near = near[apart * (den + num) <= (den - num) * (sizes[near] + sizes[k])]
            if len(near):
                links += [(int(order[j]), int(order[k])) for j in near[np.unique(root[near], return_index=True)[1]]]
                root[np.isin(root, root[near])] = root[k]
        return _stars(links, names)

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return run


def _tasks(members: DataFrame, name: str, block_shingles: int) -> DataFrame:
    """Each member once per pair of blocks of its group that it takes part in: ``block`` and the pair ``i``, ``j``."""
    by_size = F.greatest(F.ceil(F.sum("n") / F.lit(block_shingles)), F.ceil(F.count("*") / F.lit(BLOCK_SETS)))
    blocks = members.groupBy("group").agg(by_size.cast("int").alias("n_blocks"))
    placed = members.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64(F.lit(1), name), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    pair = (F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # dealt by pair: by group alone, which the joins above leave behind, a large group's pairs would be one task
    return placed.select("*", other).select("*", *pair).drop("other", "n_blocks").repartition("group", "i", "j")


def _verify(n: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        sets, seen, blocks = [], set(), []
        nodes, block = table["node"].to_pylist(), table["block"].to_pylist()
        texts = table["text"].combine_chunks()
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        kept = []
        for row, offsets, data in text_slices(texts):
            words = Words(offsets, data)
            shingles, at = shingle_hashes(words.hashes(), words.begins, n)
            for k in range(len(at) - 1):
                some = shingles[at[k] : at[k + 1]]
                node = nodes[row + k]
                if node not in seen and int(np.uint64(set_digest(some)).astype(np.int64)) == node:
                    seen.add(node)
                    sets.append(some)
                    kept.append(node)
                    blocks.append(block[row + k])
        side = np.array(blocks) if len(set(blocks)) > 1 else None
        links = links_in_block(sets, side, num, den) if len(sets) > 1 else []
        return _stars(links, kept)

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return run


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """Classes of documents whose sets of ``n``-word shingles are similar, directly or through others.

    Two documents link when den * |intersection| >= num * |union|. Words lie between white space, A-Z as a-z; a text of
    fewer words than ``n`` has its word sequence as only shingle; a text without words, or null, has none and links
    with nothing. Returns a row per row of ``docs``: the key, ``n_shingles`` and ``component_id``, the smallest key
    reachable by links, its own included. Rows with a null key get their set's size and a null component and link
    nothing; repeated rows are in one class. Every link between different sets is found; copies are never expanded.
    """
    found = _classes(docs, key, text, n, num, den)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _classes(docs: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """A row per row of ``docs``: ``id``, set size ``n``, set digest ``node``, ``component``, and whether it is the one of
    its class that ``keeps`` standing for it: the smallest id, and of one id the smallest digest."""
    rows = docs.select(col(key).alias("id"), col(text).alias("text"))
    everything = stored(index_sets(rows, n, num, den), "sets")
    sets = everything.where(F.col("id").isNotNull())
    listed = sets.where("first").select("id", "n", "node")

    found = index_rows(sets, credits_by_cost(sets, num, den))
    shared = found.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = stored(shared.select("key", "low"), "shared-subsets")
    filtered = bit_filter(shared, "key")
    if filtered is not None:
        found = found.where(filtered)
    found = stored(found.join(shared.select("key"), "key").distinct(), "found")
    found = stored(rarest(found), "rarest")
    shared = found.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    met = found.join(shared, "key").where("node <> low").select("node", "low", "band").distinct()
    met = stored(met.select("node", "low", "band", F.xxhash64("node", "band").alias("a"), F.xxhash64("low", "band").alias("b")), "candidates")
    groups = connected_components(met)
    ends = [met.select(F.col(node).alias("node"), "band", F.col(end).alias("id")) for node, end in (("node", "a"), ("low", "b"))]
    members = ends[0].unionByName(ends[1]).distinct().join(groups, "id").withColumnRenamed("component", "group")
    members = stored(members.withColumnRenamed("id", "member"), "members")

    # most that met are told apart by their sketches, a twentieth of their texts; texts travel for the others only
    sketches = sets.where("band >= 0").select("node", "band", "n", "sketch").join(members, ["node", "band"]).dropDuplicates(["member"])
    compared = _tasks(sketches.drop("node", "band"), "member", 4 * BLOCK_SHINGLES).groupBy("group", "i", "j")
    alike = connected_components(compared.applyInArrow(_alike(num, den), "a bigint, b bigint"))
    alike = members.join(alike.withColumnRenamed("id", "member"), "member")
    members = stored(alike.select("node", F.col("component").alias("group")).distinct(), "alike")

    wanted = members.select("node").distinct()
    texts = listed.join(wanted, "node").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    texts = stored(texts, "representatives")
    tasks = _tasks(members.join(texts, "node"), "node", BLOCK_SHINGLES)
    hashed = texts.select(F.xxhash64("id").alias("h"))
    near = bit_filter(hashed, "h")
    source = rows.withColumn("h", F.xxhash64("id"))
    source = (source.where(near) if near is not None else source).select("id", "text")
    work = tasks.join(source, "id").select("group", "i", "j", "block", "node", "text").repartition("group", "i", "j")
    links = work.groupBy("group", "i", "j").applyInArrow(_verify(n, num, den), "a bigint, b bigint")
    classes = connected_components(links)

    known = listed.join(classes.withColumnRenamed("id", "node"), "node", "left")
    known = known.select("id", "n", "node", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("class"))
    smallest = known.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.struct("id", "node")).alias("low"), F.count("*").alias("rows"))
    # stored, and only where it says something, so that the join below is one whose large classes Spark can split
    smallest = stored(smallest.where("rows > 1").select("class", "low"), "classes")
    keeps = F.col("low").isNull() | (F.struct("id", "node") == F.col("low"))
    named = known.join(smallest, "class", "left").select("id", "n", "node", F.coalesce("low.id", "id").alias("component"), keeps.alias("keeps"))
    unnamed = everything.where("first and id is null").select("id", "n", "node", F.col("id").alias("component"), F.lit(True).alias("keeps"))
    return named.unionByName(unnamed)


def _set_digests(text: Column, n: int) -> Column:
    """``node`` of each text's set."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = []
            for _, offsets, data in text_slices(texts):
                words = Words(offsets, data)
                shingles, at = shingle_hashes(words.hashes(), words.begins, n)
                made += [set_digest(shingles[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.array(_signed(np.array(made, dtype=np.uint64)))

    return by_batch(run, "bigint", text)


def keep_one_of_each_class(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the document with the smallest key, once.

    Rows with a null key and texts without words are like nothing else and stay. Rows that share a key are judged each by
    its own text: unlike ones stay, like ones are one class and of equal ones a single row stays. Most rows are told
    apart from the documents to drop by a bit filter; only the others are looked up, by key and digest.
    """
    classes = stored(_classes(docs, key, text, n, num, den).where("id is not null and n > 0"), "classes")
    pairs = classes.groupBy("id", "node").agg(F.min("keeps").alias("keeps"), F.count("*").alias("rows"))
    pairs = stored(pairs.where("not keeps or rows > 1").select("id", "node", "keeps"), "looked-up")
    mark, hashed, node, gone, digest = (free_name(docs, wish) for wish in ("_hit", "_hash", "_node", "_gone", "_digest"))
    hit = bit_filter(pairs.select(F.xxhash64("id").alias("h")), "h", hashed)
    marked = docs.withColumn(hashed, F.xxhash64(col(key))).withColumn(mark, F.lit(True) if hit is None else hit)
    marked = marked.withColumn(mark, F.col(mark) & col(key).isNotNull())
    doubtful = marked.where(F.col(mark)).withColumn(node, _set_digests(col(text), n))
    dropped = pairs.where("not keeps").select(F.col("id").alias(gone), F.col("node").alias(digest))
    left = doubtful.join(dropped, (col(key) == F.col(gone)) & (F.col(node) == F.col(digest)), "left_anti")
    wordless = F.col(node) == F.lit(int(np.uint64(set_digest(np.zeros(0, dtype=np.uint64))).astype(np.int64)))
    once = left.where(~wordless).dropDuplicates([key, node])
    names = [col(c) for c in docs.columns]
    return marked.where(~F.col(mark)).select(*names).unionByName(left.where(wordless).select(*names)).unionByName(once.select(*names))

"""Near duplicates by SimHash: 64-bit fingerprints of word shingles, compared exactly tile by tile.

Distinct fingerprints are laid out in tiles by the population counts of their four 16-bit quarters. A differing bit
changes one of these counts by one, so two fingerprints within ``radius`` bits lie in tiles whose counts differ by no
more in sum; all other tile pairs are skipped. What is left is compared with an exclusive-or and a bit count. Nothing is
missed: the tiles are a necessary condition, no index of likely candidates.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.arrays import strings
from citeflow.llm.components import connected_components
from citeflow.llm.frames import by_batch, col, stored
from citeflow.operators.joins import join_on_slices
from citeflow.operators.numbering import hot_groups

#: Words of a shingle, differing bits that still link, the hash's seed.
WORDS, RADIUS, SEED = 3, 2, 42
#: Text bytes hashed at a time, so a long text costs no more memory than a short one.
PIECE = 1 << 20
#: Fingerprints of a tile's slice, and the comparisons of one matrix.
TILE, MATRIX = 32_768, 1 << 21
#: Rows with one fingerprint that count as many: their join is spread.
HOT_ROWS = 10_000

SPACE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(data: bytes, n: int = WORDS) -> int:
    """Bits set in more than half of the hashes of all ``n``-word shingles, repeats included; 0 without words.

    A text of fewer words than ``n`` is one shingle. The text is taken in pieces that end between words.
    """
    ones, shingles, last, at = np.zeros(64, dtype=np.int64), 0, [], 0
    while at < len(data):
        cut = SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = cut.start() if cut else len(data)
        words = last + data[at:end].lower().split()
        hashes = _hashes(words, n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        shingles, last, at = shingles + len(hashes), words[max(0, len(words) - n + 1) :], end
    if not shingles:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED) if last else 0
    return int(np.packbits(2 * ones > shingles, bitorder="little").view(np.uint64)[0])


def _hashes(words: list[bytes], n: int) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])[: len(words) - n + 1]
    pieces = (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops[n - 1 :].tolist()))
    return np.fromiter(pieces, dtype=np.uint64, count=len(starts))


def fingerprints(text: Column, n: int = WORDS) -> Column:
    """The fingerprint of each text as a bigint with the same bits; null is empty."""

    def run(batches):
        for column in batches:
            offsets, data = strings(column)
            raw = data.tobytes()
            made = [fingerprint(raw[a:b], n) for a, b in itertools.pairwise(offsets.tolist())]
            yield pa.array(np.array(made, dtype=np.uint64).view(np.int64))

    return by_batch(run, "bigint", text)


def _tile(f: Column) -> list[Column]:
    """Population counts of the four quarters."""
    return [F.bit_count(f.bitwiseAND(F.lit(0xFFFF << 16 * k if k < 3 else -(1 << 48)))).cast("int") for k in range(4)]


def _steps(radius: int) -> list[tuple[int, ...]]:
    """How far the counts of a tile may lie from another's: each pair of tiles in one direction only, and the tile itself."""
    near = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return [d for d in near if d <= (0, 0, 0, 0)]


def _met(distinct: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """Every fingerprint in its own slice of a tile (``guest`` 0) and once in each slice it has to be compared with there.

    The table of tiles has at most 17 ** 4 rows, whatever the data, and is broadcast. A tile of more than ``tile_rows``
    fingerprints is cut into slices by hash, which meet one another as tiles do.
    """
    number = F.col("q")[0] + 17 * F.col("q")[1] + 289 * F.col("q")[2] + 4913 * F.col("q")[3]
    placed = distinct.select("f", F.array(*_tile(F.col("f"))).alias("q")).withColumn("tile", number)
    tiles = placed.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("slices"))
    tiles = F.broadcast(stored(tiles, "tiles"))
    own = placed.join(tiles, "tile").withColumn("slice", F.pmod(F.xxhash64("f"), F.col("slices")).cast("int"))
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in _steps(radius)])
    moved = own.select("f", "slice", F.col("tile").alias("home"), "q", F.explode(steps).alias("d"))
    moved = moved.withColumn("q", F.zip_with("q", "d", lambda a, b: a + b)).where(F.forall("q", lambda x: x.between(0, 16)))
    met = moved.withColumn("tile", number).join(tiles, "tile")
    met = met.select("f", "home", "slice", "tile", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    same = F.col("home") == F.col("tile")
    guest = F.when(same & (F.col("slice") == F.col("other")), 0).otherwise(1)
    owner = F.col("tile").cast("bigint") * (1 << 32) + F.col("other")
    return met.where(~same | (F.col("other") <= F.col("slice"))).select(owner.alias("owner"), guest.alias("guest"), "f")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs as connect what the given pairs connect: each member of a class with its smallest."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            break
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != root[root]).any():
            root = root[root]
    members = np.flatnonzero(root != np.arange(len(names)))
    return names[members], names[root[members]]


def near_pairs(home: np.ndarray, guests: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of fingerprints that differ in at most ``radius`` bits, a matrix at a time; ``None``: home with itself."""
    others = home if guests is None else guests
    rows = max(1, MATRIX // max(1, len(home)))
    for at in range(0, len(others), rows):
        part = others[at : at + rows]
        # as unsigned numbers: NumPy counts the bits of an absolute value
        apart = np.bitwise_count((part[:, None] ^ home[None, :]).view(np.uint64))
        i, j = np.nonzero(apart <= radius)
        if guests is None:
            i, j = i[i + at < j], j[i + at < j]
        if len(i):
            yield stars(part[i], home[j])


def _compare(radius: int):
    """Streams over slices sorted by owner, a slice's own fingerprints first: only those are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, home = None, [], None
        for batch in batches:
            owner = batch["owner"].to_numpy()
            guest = batch["guest"].to_numpy()
            f = batch["f"].to_numpy()
            cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (guest[1:] != guest[:-1])) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(owner)] if len(owner) else []):
                links = []
                if owner[a] != now:
                    if home is None and own:
                        links += near_pairs(np.concatenate(own), None, radius)
                    now, own, home = owner[a], [], None
                if not guest[a]:
                    own.append(f[a:b].copy())
                else:
                    if home is None:
                        home = np.concatenate([f[:0], *own])
                        links += near_pairs(home, None, radius)
                    links += near_pairs(home, f[a:b], radius)
                yield from map(_edges, links)
        if home is None and own:
            yield from map(_edges, near_pairs(np.concatenate(own), None, radius))

    return run


def _edges(link: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(link[0]), pa.array(link[1])], names=["a", "b"])


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, radius: int = RADIUS, tile_rows: int = TILE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The fingerprint of every row and the class it is in: rows whose fingerprints differ in at most ``radius`` bits link.

    Returns a row per row of ``docs``: the key, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key
    reachable by links, its own included. Words lie between white space, A-Z as a-z; null and empty texts have the
    fingerprint zero and link like any other, so do repeated rows and repeated keys. A row with a null key links, and
    gets the smallest key of its class, null where the class has none. Other columns are not read. Copies are compared
    once: only distinct fingerprints meet, and a class of links leaves a task as one pair a member.
    """
    rows = stored(docs.select(col(key).alias("id"), fingerprints(col(text), n).alias("f")), "fingerprints")
    distinct = stored(rows.groupBy("f").agg(F.min("id").alias("low"), F.count("*").alias("_n")), "distinct")
    met = _met(distinct, radius, tile_rows).repartition("owner").sortWithinPartitions("owner", "guest")
    classes = connected_components(met.mapInArrow(_compare(radius), "a bigint, b bigint"))
    named = distinct.join(classes.withColumnRenamed("id", "f"), "f", "left").select("f", "low", F.coalesce("component", "f").alias("class"))
    smallest = named.groupBy("class").agg(F.min("low").alias("component_id"))
    named = named.join(smallest, "class").select("f", "component_id")
    found = join_on_slices(rows, named, "f", "inner", _hot(distinct, hot_rows), salt=F.xxhash64("id"))
    digits = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return found.select(F.col("id").alias(key), digits.alias("fingerprint"), "component_id")


def _hot(distinct: DataFrame, hot_rows: int) -> DataFrame | None:
    hot = hot_groups(distinct.select("f", "_n"), hot_rows)
    return hot.select("f", "_slices") if hot is not None else None

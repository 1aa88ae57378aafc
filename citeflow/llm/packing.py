"""Packing of tokenised documents into sequences of fixed size: configuration linear program, then best fit.

Only the histogram of piece lengths (at most one entry per length up to the capacity) reaches the driver. There a
configuration linear program is solved by multiplicative weights: each round prices the lengths by how badly they are
covered so far and a knapsack dynamic program finds the fullest configuration at these prices. Whole multiples of the
configurations are kept, the program is solved again for what is left, and the last pieces go best-fit into free space
or new sequences. The plan is a list of runs of equal sequences whose size depends on the capacity and the rounds, not on
the documents; every piece looks its place up by its length and its number among the pieces of that length.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from citeflow.llm.bpe import PATTERN, byte_tokens
from citeflow.llm.frames import by_batch, col, stored

#: Rounds of multiplicative weights aimed at (at most twice as many are made), configurations taken from one round's dynamic
#: program, and how near to the dearest they must be: a solution has at most twice the product of the first two.
ROUNDS, TOGETHER, NEARLY = 150, 8, 0.98
#: The most of a length's pieces that one configuration may cover in a round, and the sharpness of the weights.
STEP, SHARPNESS = 0.2, 12.0
#: How often the program is solved: for all pieces, then for those that rounding left over.
SOLVED = 3
#: In the rounding that leaves small pieces to best fit, these are the ones up to this part of the capacity.
LARGE = 1 / 3
#: Texts above this many characters go to the plain tokenizer, whose memory does not depend on a pattern's back-tracking.
LONG_TEXT = 1_000_000

Items = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Run:
    """``count`` equal sequences, each with ``(length, how many)`` pieces."""

    count: int
    items: Items

    def used(self) -> int:
        return sum(length * many for length, many in self.items)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each space the value of its dearest content and the last length in it (0: one left free).

    The index of a price is its length.
    """
    value = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    for space in range(1, capacity + 1):
        with_last = prices[1 : space + 1] + value[space - 1 :: -1]
        k = int(with_last.argmax())
        if with_last[k] > value[space - 1]:
            value[space], choice[space] = with_last[k], k + 1
        else:
            value[space] = value[space - 1]
    return value, choice


def contents(choice: np.ndarray, space: int) -> dict[int, int]:
    found: dict[int, int] = {}
    while space > 0:
        last = int(choice[space])
        if last:
            found[last] = found.get(last, 0) + 1
        space -= last or 1
    return found


def configurations(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> dict[Items, float]:
    """A fractional solution of the configuration program: how often each configuration is used to cover all pieces.

    One dynamic program prices all configurations of a round: for each length, the dearest one that holds it. Those
    within ``NEARLY`` of the dearest, ``TOGETHER`` at most, each cover a step of their scarcest length. The step is such
    that about ``rounds`` rounds cover everything once; the solution is scaled until its worst covered length is covered
    exactly, so that no length pays for the pace of another.
    """
    if not histogram:
        return {}
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], dtype=np.float64)
    at = {n: k for k, n in enumerate(lengths.tolist())}
    covered = np.zeros(len(lengths))
    solution: dict[Items, float] = {}
    pieces_each = capacity * counts.sum() / (lengths * counts).sum()
    pace = min(STEP, len(lengths) / (pieces_each * max(1, rounds) * TOGETHER))
    for _ in range(2 * rounds):
        share = covered / counts
        if share.min() >= 1:
            break
        prices = np.full(capacity + 1, -np.inf)
        prices[lengths] = np.exp(-SHARPNESS * (share - share.min())) / counts
        value, choice = knapsack(prices, capacity)
        holding = prices[lengths] + value[capacity - lengths]
        good = np.flatnonzero(holding >= NEARLY * value[capacity])
        for k in good[np.argsort(-holding[good], kind="stable")][:TOGETHER]:
            items = contents(choice, capacity - int(lengths[k]))
            items[int(lengths[k])] = items.get(int(lengths[k]), 0) + 1
            items = {n: min(many, histogram[n]) for n, many in items.items()}
            step = pace * min(histogram[n] / many for n, many in items.items())
            for n, many in items.items():
                covered[at[n]] += step * many
            key = tuple(sorted(items.items(), reverse=True))
            solution[key] = solution.get(key, 0.0) + step
    least = float((covered / counts).min())
    return {items: times / least for items, times in solution.items()} if least > 0 else solution


def _rounded(solution: dict[Items, float], left: dict[int, int]) -> tuple[list[Run], dict[int, int]]:
    """Whole multiples of the configurations, the most used first, as far as the pieces last; and the pieces left."""
    runs, left = [], dict(left)
    for items, times in sorted(solution.items(), key=lambda s: (-s[1], s[0])):
        whole = min([math.floor(times), *(left[n] // many for n, many in items)])
        if whole > 0:
            runs.append(Run(whole, items))
            for n, many in items:
                left[n] -= whole * many
    return runs, {n: many for n, many in left.items() if many}


def _sequences(runs: list[Run]) -> int:
    return sum(run.count for run in runs)


def plan_runs(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[Run]:
    """Runs of equal sequences that hold exactly the pieces of the histogram.

    The fractional solution is rounded in two ways, and the plan with fewer sequences is returned; best fit alone where
    it is below both, so the plan never needs more than that. Either whole multiples of the configurations are kept and
    the program is solved again for the pieces that are left; or the small pieces of the configurations are taken out
    before rounding, which pays where many pieces are small: they fill any space. In both best fit places the rest.
    """
    left = {n: many for n, many in histogram.items() if many > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is empty or longer than a sequence")
    full = [Run(left.pop(capacity), ((capacity, 1),))] if capacity in left else []
    first = solution = configurations(left, capacity, rounds)
    whole, rest = list(full), left
    for again in range(SOLVED):
        runs, rest = _rounded(solution, rest)
        whole += runs
        if not runs or not rest or again == SOLVED - 1:
            break
        solution = configurations(rest, capacity, rounds)
    large: dict[Items, float] = {}
    for items, times in first.items():
        kept = tuple((n, many) for n, many in items if n > capacity * LARGE)
        if kept:
            large[kept] = large.get(kept, 0.0) + times
    runs, others = _rounded(large, left)
    plans = [best_fit(whole, rest, capacity), best_fit(full + runs, others, capacity), best_fit(full, left, capacity)]
    return min(plans, key=_sequences)


def best_fit(runs: list[Run], left: dict[int, int], capacity: int) -> list[Run]:
    """Put the pieces that are left, longest first, where they leave the least space; new sequences when none has room.

    Equal sequences are treated together. The tightest ones take as many pieces as they hold before the next are used,
    as one piece more makes a sequence tighter still.
    """
    by_space: dict[int, list[Run]] = {}
    spaces: list[int] = []

    def add(run: Run) -> None:
        space = capacity - run.used()
        if space not in by_space:
            by_space[space] = []
            insort(spaces, space)
        by_space[space].append(run)

    for run in runs:
        add(run)
    for n in sorted(left, reverse=True):
        rest = left[n]
        while rest:
            k = bisect_left(spaces, n)
            if k < len(spaces):
                space = spaces[k]
                run = by_space[space].pop()
                if not by_space[space]:
                    del by_space[space], spaces[k]
            else:
                space, run = capacity, Run(rest, ())
            each = space // n
            full, one = divmod(min(rest, run.count * each), each)
            if full:
                add(Run(full, (*run.items, (n, each))))
            if one:
                add(Run(1, (*run.items, (n, one))))
            if run.items and run.count > full + bool(one):
                add(Run(run.count - full - bool(one), run.items))
            rest -= full * each + one
    return [run for space in spaces for run in by_space[space]]


def places(runs: list[Run]) -> np.ndarray:
    """Per length and run: length, number of the first such piece, first sequence, pieces a sequence, offset."""
    rows, numbered, sequence = [], {}, 0
    for run in runs:
        offset = 0
        for n, many in run.items:
            rows.append((n, numbered.get(n, 0), sequence, many, offset))
            numbered[n] = numbered.get(n, 0) + many * run.count
            offset += n * many
        sequence += run.count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _placer(table: np.ndarray):
    keys = (table[:, 0].astype(np.uint64) << np.uint64(44)) + table[:, 1].astype(np.uint64)

    def place(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        n, number = (np.asarray(x.to_numpy(zero_copy_only=False), dtype=np.int64) for x in (lengths, numbers))
        wanted = (n.astype(np.uint64) << np.uint64(44)) + number.astype(np.uint64)
        row = table[np.searchsorted(keys, wanted, "right") - 1] if len(table) else np.zeros((len(n), 5), dtype=np.int64)
        nth, slot = np.divmod(number - row[:, 1], np.maximum(row[:, 3], 1))
        return pa.StructArray.from_arrays(
            [pa.array(row[:, 2] + nth), pa.array(row[:, 4] + slot * n)], names=["sequence_id", "offset"]
        )

    place.__annotations__ = {"lengths": pa.Array, "numbers": pa.Array, "return": pa.Array}
    return F.arrow_udf(place, "struct<sequence_id:bigint,offset:bigint>")


_encoders: dict[str, tuple] = {}


def _encoder(path: str):
    """Ids of a text as the ``tokenizers`` library gives them, by a faster library where both agree.

    The faster one takes the vocabulary's ids as ranks, so it is used when ids follow the order of the merges, and for
    texts without the string of a special token.
    """
    if path not in _encoders:
        plain = Tokenizer.from_file(path)
        plain.no_truncation()
        plain.no_padding()
        tokens, special, ordered = byte_tokens(path)
        fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={}) if ordered else None
        _encoders[path] = plain, fast, list(special)
    plain, fast, special = _encoders[path]

    def ids(text: str) -> list[int]:
        if fast is None or len(text) > LONG_TEXT or any(s in text for s in special):
            return plain.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def pieces_of(text: Column, path: str, capacity: int, end_id: int, keep_ids: bool = False) -> Column:
    """Array of the pieces of each text: ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``.

    A text's ids and the end id follow each other; only when they exceed the capacity are they cut, into full pieces
    but for the first.
    """
    kind = pa.struct(
        [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        + ([("ids", pa.list_(pa.int32()))] if keep_ids else [])
    )

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _encoder(path)
        for texts in batches:
            rows = []
            for text in texts:
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                row = []
                for start, end in zip(cuts, cuts[1:], strict=False):
                    piece = {"start": start, "length": end - start, "ids_crc32": zlib.crc32(ids[start:end].tobytes())}
                    row.append(piece | ({"ids": ids[start:end].astype(np.int32)} if keep_ids else {}))
                rows.append(row)
            yield pa.array(rows, pa.list_(kind))

    ids = ",ids:array<int>" if keep_ids else ""
    return by_batch(run, f"array<struct<start:bigint,length:bigint,ids_crc32:bigint{ids}>>", text)


def pack_documents(
    docs: DataFrame,
    path: str,
    capacity: int = 1024,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Returns a row per piece: the document's id, ``piece`` (from 0), ``start`` (ids of its document before it),
    ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (its place in the sequence), and ``ids`` on request. A null or
    empty text is a document of the end id alone. Repeated rows are packed each for itself, null ids too. Other columns
    are ignored. The pieces are stored once, then numbered per length inside each stored file and offset by the files
    before it, so that a length that most pieces have is never gathered in one task.
    """
    cut = docs.select(col(doc_id).alias("doc_id"), F.posexplode(pieces_of(col(text), path, capacity, end_id, keep_ids)))
    pieces = stored(cut.select("doc_id", F.col("pos").alias("piece"), "col.*"), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan_runs(histogram, capacity, rounds))

    placed = pieces.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    earlier = Window.partitionBy("length").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("length", "_file")
        .agg(F.count("*").alias("_n"))
        .select("length", "_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    in_file = F.row_number().over(Window.partitionBy("_file", "length").orderBy("_row"))
    numbered = (
        placed.withColumn("_nth", in_file)
        .join(before, ["_file", "length"])
        .withColumn("_place", _placer(table)("length", F.col("_before") + F.col("_nth") - 1))
    )
    made = ["piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return numbered.select(
        F.col("doc_id").alias(doc_id), *made, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset")
    )

"""Units of equal and overlapping contexts, and the split that keeps them whole."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from citeflow.operators import audit, units
from citeflow.operators.graph import components
from citeflow.params import SplitRatios


def texts():
    rng = random.Random(6)
    word = lambda: rng.choice("court held the appeal motion under rule".split()) + str(rng.randint(0, 40))
    rows = [None, "", " \n", "short", "Short ", "sh ort"]
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 7, 12, 30]))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 5])):
            some = list(base)
            some[rng.randrange(len(some))] = "edit"
            rows.append(rng.choice(["  ", " ", "\t"]).join(some).upper())
    rows += ["the same text again"] * 60 + [f"one two three four five {i}" for i in range(70)]
    return list(enumerate(rows))


def base_units(rows, edge):
    said = {i: (t or "").lower().split() for i, t in rows}
    group = {i: i for i, _ in rows}
    seen: dict = {}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, words in said.items():
        keys = [("all", *words)] if words else []
        if len(words) >= edge:
            keys += [("first", *words[:edge]), ("last", *words[-edge:])]
        for key in keys:
            group[find(i)] = find(seen.setdefault(key, i))
    return {frozenset(j for j in said if find(j) == find(i)) for i in said}


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_units(spark, hot_rows):
    rows = texts()
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(3)
    got = units.context_units(df, "text", edge_words=5, hot_rows=hot_rows).collect()
    members: dict = {}
    for r in got:
        members.setdefault(r.unit, set()).add(r.row_id)
    assert len(got) == len(rows) and {frozenset(m) for m in members.values()} == base_units(rows, 5)
    split = units.split_units(df, units.context_units(df, "text", edge_words=5), hot_rows=hot_rows)
    assert split.count() == len(rows)
    sides: dict = {}
    for r in split.collect():
        sides.setdefault(r.row_id, r.split)
    assert all(len({sides[i] for i in m}) == 1 for m in members.values())
    assert audit.split_overlap(split.select("split", F.lower(F.trim("text")).alias("t")).where("t <> ''"), ["t"]).isEmpty()


def test_units_fill_the_quotas():
    rng = random.Random(9)
    for _ in range(400):
        sizes = {rng.choice([1, 2, 3, 9, rng.randint(1, 300)]): rng.choice([1, 2, 5, 80]) for _ in range(rng.randint(1, 9))}
        rows = sum(n * m for n, m in sizes.items())
        train = rng.randint(0, rows)
        valid = rng.randint(0, rows - train)
        quotas = (train, valid, rows - train - valid)
        placed = units.place_units(list(sizes.items()), quotas)
        assert {n: sum(given) for n, given in placed.items()} == sizes and min(min(g) for g in placed.values()) >= 0
        for j in range(3):
            assert abs(sum(n * given[j] for n, given in placed.items()) - quotas[j]) <= max(sizes)
    assert units.place_units([(40, 1), (1, 60)], (80, 10, 10)) == {40: (1, 0, 0), 1: (40, 10, 10)}


def test_units_of_one_size_are_placed_by_hash(spark):
    rows = [(i, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, text string")
    named = units.context_units(df, "text")
    split = units.split_units(df, named, SplitRatios(), 7).join(named, "row_id").collect()
    order = sorted(split, key=lambda r: hashlib.md5(f"7|{r.unit}".encode()).hexdigest())
    assert [r.split for r in order] == ["train"] * 80 + ["valid"] * 10 + ["test"] * 10
    assert units.split_units(df.limit(0), named.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 105), (105, 101)]
    got = {r.id: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

"""Fingerprints and their classes against a plain version."""

import random
import re

import pytest
import xxhash

from citeflow.llm import simhash


def plain(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, radius=2):
    """(id, fingerprint) rows to {fingerprint: smallest id reachable}."""
    found, left = {}, {f for _, f in rows}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            f = todo.pop()
            seen.add(f)
            near = {g for g in left if (f ^ g).bit_count() <= radius}
            left -= near
            todo += near
        ids = [i for i, f in rows if f in seen and i is not None]
        found |= dict.fromkeys(seen, min(ids, default=None))
    return found


def documents():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "A b", "a\x0bB", "a b c", "É\x85é ü\xa0x y", "word " * 500, "x " * 3 + "🎉" * 50]
    for _ in range(12):
        base = [rng.choice("the of and court held that plaintiff appeal motion".split()) + str(rng.randint(0, 9)) for _ in range(400)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(400)] = "edit"
            texts.append(" ".join(copy))
    texts += texts[:40] + ["lone"] * 60
    return [(i if i % 17 else None, t) for i, t in enumerate(texts)]


def test_fingerprint_in_pieces(monkeypatch):
    texts = [t for _, t in documents() if t]
    whole = [simhash.fingerprint(t.encode()) for t in texts]
    assert whole == [plain(t) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert [simhash.fingerprint(t.encode()) for t in texts] == whole


@pytest.mark.parametrize("tile_rows, hot_rows", [(10_000, 10_000), (2, 20)])
def test_classes(spark, tile_rows, hot_rows):
    rows = documents()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, F string, component_id int").repartition(5)
    got = simhash.simhash_components(df, tile_rows=tile_rows, hot_rows=hot_rows)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [(i, plain(t)) for i, t in rows]
    named = classes(prints)
    order = lambda r: tuple((x is not None, x) for x in r)
    expected = sorted([(i, f"{f:016x}", named[f]) for i, f in prints], key=order)
    assert sorted(map(tuple, got.collect()), key=order) == expected
    assert len(set(named.values())) < len(named)


def test_tiles_miss_no_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(300)] + [0, 2**64 - 1, 1 << 63]
    near = [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in base for _ in range(3)]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in {*base, *near}]
    met = simhash._met(spark.createDataFrame(signed, "f long"), 2, 5).repartition(3, "owner").sortWithinPartitions("owner", "guest")
    edges = [(r.a % 2**64, r.b % 2**64) for r in met.mapInArrow(simhash._compare(2), "a bigint, b bigint").collect()]
    root = {f: f for f in {*base, *near}}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    known = classes([(f, f) for f in root])
    assert {frozenset(g for g in root if find(g) == find(f)) for f in root} == {frozenset(g for g in root if known[g] == known[f]) for f in root}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(none).collect() == []

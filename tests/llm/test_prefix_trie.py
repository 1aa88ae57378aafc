"""The conversations' prefix trie against nested dictionaries."""

import hashlib
import random
import zlib

import pytest

from citeflow.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    turns: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            digest = hashlib.md5(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).digest()
            turns.setdefault(conv, []).append(((turn is not None, turn), digest, said))
    ordered = {c: [t[2] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in turns.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in ordered}
    return {c: ordered.get(c - c % 5, [])[: heads[c]] + ordered[c][heads[c] :] for c in ordered}


def plain(rows):
    members: dict = {}
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[b] for b in below) or 1
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own + sum(saved[b] for b in below)
    out = []
    for path, convs_here in members.items():
        ends = ",".join(map(str, sorted(c for c in convs_here if len(convs[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs_here), len(path), parent, len(convs_here), len(children.get(path, [])), leaves[path], saved[path], digest))
    return out


def order(row):
    return tuple((x is not None, x) for x in row)


def table(seed=1, convs=160):
    rng = random.Random(seed)
    said = [None, "", "hi", "é🎉 ü", "long " * 900, "yes", "no", "why?"]
    rows = []
    for c in range(convs):
        if rng.random() < 0.05:
            continue
        for turn in range(rng.choice([1, 2, 3, 8, 12])):
            rows.append((c, turn if rng.random() < 0.97 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(said[: rng.choice([2, 3, 8])])))
    copied = [(turn, "user", f"t{turn % 3}") for turn in range(18)]
    rows += [(c, *t) for c in range(500, 560) for t in copied]  # sixty long copies
    rows += [(c, *t) for c in range(700, 703) for t in copied * 2]  # repeated rows
    return [*rows, (None, 1, "user", "lost"), (-7, 0, "user", "below zero"), (10**12, 0, "user", "hi")]


@pytest.mark.parametrize("container_turns, levels", [(20_000, 16), (1, 16), (30, 4)])
def test_against_dictionaries(spark, container_turns, levels):
    rows = [(*r, "x", 0) for r in table() if r[0] is None or r[0] >= 0]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string, depth int").repartition(6)
    got = prefix_trie.prefix_trie(df, container_turns=container_turns, levels=levels)
    assert tuple(got.columns) == COLUMNS
    assert sorted(map(tuple, got.collect()), key=order) == sorted(plain([r[:4] for r in rows]), key=order)


def test_no_container_outgrows_its_limit(spark):
    rows = [r for r in table() if r[0] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seqs = prefix_trie.sequences(prefix_trie.rebuild(prefix_trie.conversations(df)))
    heads, placed = prefix_trie.burst(seqs, 25, 4)
    sizes: dict = {}
    for r in placed.where("depth >= 0").collect():
        sizes.setdefault(bytes(r.path[r.depth]), []).append(r.n - r.depth)
    assert all(len(s) == 1 or sum(s) <= 25 for s in sizes.values())
    assert placed.select("c").distinct().count() == placed.count() == seqs.count() and heads.count() > 18


def test_empty_and_turnless(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], kind)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], kind)).collect() == []
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(lone, 1, "user", "x")]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, kind)).collect()
    assert list(map(tuple, got)) == plain(rows) and len(got) == 1

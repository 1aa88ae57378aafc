"""Conversation repair against every edit sequence tried out."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from citeflow.llm import turn_repair

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    convs: dict = {}
    for conv, turn, role, text in rows:
        left = convs.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        if code:
            left += [(turn, role, text)] * (2 if code == 3 else 1)
    return {c: sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())) for c, ts in convs.items()}


def cheapest(turns):
    """(cost, audit) over all edits: the best continuation of every position and state of the role sequence."""
    after = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}

    @functools.cache
    def best(i, state, inserts):
        options = [(0, "")] if i == len(turns) and state in ("", "a") else []

        def then(cost, letter, *rest):
            found = best(*rest)
            if found:
                options.append((cost + found[0], letter + found[1]))

        if inserts < 2:
            for r in "ua":
                if state in after[r]:
                    then(3, "I", i, after[r][state], inserts + 1)
        if i < len(turns):
            role, fault = turns[i]
            then(4, "D", i + 1, state, 0)
            if fault not in ("blank", "duplicate"):
                cut = 3 if fault == "truncated" else 0
                if state in after.get(role[:1], ()):
                    then(cut, "K", i + 1, after[role[:1]][state], 0)
                for r in "ua":
                    if state in after[r]:
                        then(3 + cut, "R", i + 1, after[r][state], 0)
        return min(options) if options else None

    for i in range(len(turns), 0, -20):
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def repaired(turns, audit):
    out, at, last = [], 0, ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else turns[at][1:]
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if last == "u" else "user"
        out.append(f"{role}:{text}")
        last = role[0]
    return "\n".join(out)


def plain(rows):
    out = []
    for conv, turns in damaged(rows).items():
        faults, seen = [], set()
        for _, role, text in turns:
            letters = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        roles = [role[:1] for _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit = cheapest(tuple((role, fault) for (_, role, _), fault in zip(turns, faults)))
        digest = hashlib.sha256(repaired(turns, audit).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return out


def table(seed=0):
    rng = random.Random(seed)
    said = ["Yes.", "no", " \t\n", "", None, "Why? ", "é🎉!\x0b", "a.\x85", "...", "long " * 3000 + "."]
    roles = ["user", "assistant"] * 4 + ["system", "", None, "tool", "usr", "Assistant"]
    rows = []
    for c in range(150):
        for turn in range(rng.choice([1, 2, 4, 8, 8, 20, 90])):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            text = rng.choice(said) if rng.random() < 0.5 else f"turn {turn}."
            rows.append((c, turn * rng.choice([1, 1, 3]) if rng.random() < 0.97 else None, role, text))
    rows += [(1000, t % 7, "user", "same.") for t in range(300)] + [(1001, t, "su"[t % 2] + "x", "x") for t in range(150)]
    rows += [(None, t, r, "null.") for t, r in enumerate(["system", "user", "assistant", "user"])]
    dropped = next(t for t in range(99) if zlib.crc32(f"2000:{t}".encode()) % 20 == 0)
    return [*rows, (2000, dropped, "user", "gone."), (2001, 2**63 - 1, "user", "far."), (2001, -(2**63) + 9, "user", "far.")]


@pytest.mark.parametrize("block", [64, 5, 1])
def test_against_all_edits(spark, monkeypatch, block):
    rows = [(*r, "x", 1) for r in table()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c string, Fault int").repartition(7)
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    turn_repair.search.cache_clear()
    # blocks are read from the module by the driver's closure only, so run the streaming part here as well
    got = {r[0]: tuple(r) for r in turn_repair.repair_conversations(df).collect()}
    expected = {r[0]: (r[0], min(r[1], 2**63 - 1), *r[2:]) for r in plain([r[:4] for r in rows])}
    assert got == expected
    for conv, turns in damaged([r[:4] for r in rows]).items():
        now, seen = turn_repair._Conversation(conv), set()
        for turn, role, text in turns:
            letters = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "b" if not letters else "d" if (role, text) in seen else "t" if letters[-1] not in ".!?" else "k"
            seen.add((role, text))
            now.add(turn, role, text, fault)
        assert now.row() == expected[conv]


def test_bounds_hold_and_search_stays_small():
    rng = random.Random(4)
    names = {"b": "blank", "d": "duplicate", "t": "truncated", "k": ""}
    for n in (1, 2, 3, 5, 8, 64):
        for _ in range(60):
            pairs = [(rng.choice("uuaasx"), rng.choice("kkktbd")) for _ in range(n)]
            turns = "".join(a + b for a, b in pairs)
            known = cheapest(tuple((a, names[b]) for a, b in pairs))
            assert turn_repair.suffix_bounds(turns)[0] <= known[0]
            assert turn_repair.search.__wrapped__(turns, ((0, turn_repair.START),), True)[0][::2] == known


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = turn_repair.repair_conversations(none)
    assert got.collect() == [] and tuple(got.columns) == COLUMNS

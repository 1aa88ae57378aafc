"""Repair of conversations whose turns were lost, emptied, cut, repeated or given the wrong role.

A repaired conversation's roles are an optional system turn, then user and assistant in turn, ending with the assistant.
The cheapest edits are searched depth first by branch and bound. A conversation streams through a task: its turns are
searched a block at a time, from every state the block before can end in, so memory is that of a block and not of the
conversation.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeflow.llm.frames import col

#: Turns searched at once; blocks whose result a worker remembers (many are alike); rows that are Python objects at a time.
BLOCK, REMEMBERED, ROWS = 64, 50_000, 256

#: What a turn's repair costs.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3

#: Roles of what was said so far: nothing, a system turn, user last, assistant last.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: States that edits can lead to from each.
REACHED = {START: (START, SYSTEM, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (USER, ASSISTANT)}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after a turn of that role, where it may follow.
NEXT = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
LEGAL = ("su", "ua", "au")
INFINITE = 1 << 60

FIELDS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
SPACES = "[\\x20\\x09-\\x0D]"


def damage(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(``c``, ``t``, ``role``, ``text``, ``gone``): rows after damage by ``crc32(conv:turn) % 20``.

    Nulls count as one space there and as role or text. A dropped row stays, marked as ``gone`` and empty, so that its
    conversation is not forgotten.
    """
    spoken = [F.coalesce(col(name).cast("string"), F.lit(" ")) for name in (conv, turn)]
    code = F.crc32(F.concat(spoken[0], F.lit(":"), spoken[1]).cast("binary")) % 20
    read = rows.select(
        col(conv).alias("c"),
        col(turn).alias("t"),
        F.coalesce(col(role), F.lit(" ")).alias("role"),
        F.coalesce(col(text), F.lit(" ")).alias("text"),
        code.alias("code"),
    )
    hurt = (
        F.when(F.col("code") <= 1, "")
        .when(F.col("code") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    said_by = F.when(F.col("code") == 0, "").when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    return read.select("c", "t", said_by.alias("role"), hurt.alias("text"), (F.col("code") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def kind_of(said_by: Column, text: Column, seen: Column) -> Column:
    """One letter for a turn's first fault: ``b`` blank, ``d`` said before, ``t`` cut off, ``k`` none."""
    return (
        F.when(~text.rlike(f"[^{SPACES[1:-1]}]"), "b").when(seen, "d").when(~text.rlike(f"[.!?]{SPACES}*\\z"), "t").otherwise("k")
    )


def suffix_bounds(turns: str) -> list[int]:
    """What the edits of the turns from each one on cost at least, whatever comes before.

    Every turn pays for itself: its deletion where it has to go, its cut text or its foreign role otherwise. Two turns
    in a row that share a role pay once more, a pair at a time: for a role, a deletion or an insert between them.
    """
    n = len(turns) // 2
    bounds, own, after = [0] * (n + 1), [0] * n, [n] * n
    following = n
    for i in range(n - 1, -1, -1):
        who, fault = turns[2 * i], turns[2 * i + 1]
        if fault in "bd":
            own[i], pair = DELETE, 0
        else:
            cut = CUT if fault == "t" else 0
            own[i] = cut if who in "sua" else min(DELETE, REROLE + cut)
            pair, j = 0, following
            if j < n and who == turns[2 * j] and who in "ua":
                extra = min(INSERT, REROLE, DELETE - max(own[i], own[j]))
                between = DELETE * (j - i - 1)
                pair = own[i] + between + own[j] + extra + bounds[j + 1]
            following = i
        bounds[i] = max(own[i] + bounds[i + 1], pair)
    return bounds


@functools.lru_cache(REMEMBERED)
def search(turns: str, roots: tuple, last: bool) -> tuple:
    """The best (cost, root, audit, state) of each state that the edits of ``turns`` can end in, smallest audit first;
    only the best of all where they are the ``last``.

    ``turns`` has two letters a turn, role initial and fault. ``roots`` are (cost, state), best audit so far first; a
    root's number stands for its audit, whose last letter used up a turn, as that of every result does: inserts after
    the last turn belong to what follows, unless ``last``. Depth first with an explicit stack; a node is a number of
    used turns and a state. Its table keeps the best prefix that reached it, any worse one is dropped (dominance), and
    so is one whose cost and bound do not beat the results there are (bound). The table is right for ties too: of two
    equally cheap prefixes at a node neither continues the other, so the smaller one stays smaller whatever follows.
    """
    n, bounds = len(turns) // 2, suffix_bounds(turns)
    best: dict[tuple[int, int], tuple] = {}
    found: dict[int, tuple] = {}
    stack = [(cost, root, "", 0, state) for root, (cost, state) in reversed(list(enumerate(roots)))]
    while stack:
        node = stack.pop()
        cost, root, audit, i, state = node
        prefix = (cost, root, audit)
        at = (i, state)
        if at in best and best[at] <= prefix:
            continue
        # the incumbents: what this prefix can still become has to beat one of them
        rivals = found.values() if last else [found.get(s, (INFINITE,)) for s in REACHED[state]]
        if rivals and (min if last else max)(r[0] for r in rivals) < cost + bounds[i]:
            continue
        best[at] = prefix
        if i == n and (not last or state in FINAL) and (state not in found or prefix < found[state]):
            found[state] = prefix
        children = []
        if i < n:
            who, fault = turns[2 * i], turns[2 * i + 1]
            extra = CUT if fault == "t" else 0
            if fault not in "bd":
                if state in NEXT.get(who, ()):
                    children.append((cost + extra, root, audit + "K", i + 1, NEXT[who][state]))
                children += [(cost + REROLE + extra, root, audit + "R", i + 1, NEXT[r][state]) for r in "ua" if r != who and state in NEXT[r]]
            children.append((cost + DELETE, root, audit + "D", i + 1, state))
        if i < n or last:
            children += [(cost + INSERT, root, audit + "I", i, NEXT[r][state]) for r in "ua" if state in NEXT[r]]
        children.sort(key=lambda c: (c[0] + bounds[c[3]], c[2]), reverse=True)
        stack += children
    ends = [(*prefix, state) for state, prefix in found.items()]
    return (min(ends),) if last else tuple(sorted(ends, key=lambda e: e[1:]))


class _Conversation:
    """Counts, and for every state the turns so far can end in: cost, audit and digest of the repaired text."""

    def __init__(self, conv):
        self.conv = conv
        self.low = self.high = self.turn = None
        self.distinct = self.illegal = 0
        self.faults = {"b": 0, "d": 0, "t": 0, "k": 0}
        self.before = None
        self.block: list[tuple[str, str, str]] = []
        # by state, smallest audit first; an audit is a chain of the blocks' audits, last first
        self.ends = {START: (0, None, hashlib.sha256(), False)}

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.distinct += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        self.faults[fault] += 1
        self.block.append((role, text, fault))
        if len(self.block) > BLOCK:
            kept = self.block.pop()
            self.finish_block(False)
            self.block.append(kept)

    def finish_block(self, last: bool) -> None:
        roots = list(self.ends.items())
        least = min(end[0] for _, end in roots)
        turns = "".join((r[:1] if r[:1] in ("s", "u", "a") else "x") + f for r, _, f in self.block)
        self.ends = {}
        for cost, root, audit, state in search(turns, tuple((end[0] - least, start) for start, end in roots), last):
            start, (_, audits, digest, spoke) = roots[root]
            digest = digest.copy()
            for piece in _rendered(start, self.block, audit):
                digest.update(b"\n" + piece if spoke else piece)
                spoke = True
            self.ends[state] = (least + cost, (audits, audit), digest, spoke)
        self.block = []

    def row(self) -> tuple:
        self.finish_block(True)
        ((cost, chain, digest, _),) = self.ends.values()
        audits = []
        while chain:
            chain, audit = chain
            audits.append(audit)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)
        counts = (self.faults["b"], self.faults["d"], self.faults["t"], self.illegal)
        return (self.conv, gaps, *counts, cost, "".join(reversed(audits)), digest.hexdigest())


def _rendered(state: int, block: list[tuple[str, str, str]], audit: str) -> Iterator[bytes]:
    """The turns that the edits leave, as ``role:text``."""
    at = 0
    for edit in audit:
        if edit == "I":
            state = ASSISTANT if state == USER else USER
            yield f"{ROLE[state]}:".encode()
            continue
        role, text, _ = block[at]
        at += 1
        if edit == "D":
            continue
        if edit == "K":
            state = NEXT[role[:1]][state]
        else:
            state = ASSISTANT if state == USER else USER
            role = ROLE[state]
        yield f"{role}:{text}".encode()


def _repair(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                for row in batch.slice(at, ROWS).to_pylist():
                    if now is None or row["c"] != now.conv:
                        if now:
                            done.append(now.row())
                        now = _Conversation(row["c"])
                    if not row["gone"]:
                        now.add(row["t"], row["role"], row["text"], row["fault"])
            if done:
                yield _batch(done, kind)
        if now:
            yield _batch([now.row()], kind)

    return run


def _batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["c", *[f.split()[0] for f in FIELDS.split(", ")]]
    columns = [pa.array(c, k) for c, k in zip(zip(*done), kinds)]
    done.clear()
    return pa.RecordBatch.from_arrays(columns, names=names)


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Faults of every damaged conversation, and the cheapest edits that give it a legal sequence of roles.

    Returns per conversation id, null included: ``gaps``, ``blank``, ``duplicate``, ``truncated`` and ``illegal``
    counts, the ``cost`` of the edits, their ``audit`` (Keep, Rerole, Delete and Insert by initials, of equally cheap
    ones the ASCII-least) and ``repaired_sha256`` of the repaired turns. A conversation none of whose rows are left has
    zeros, an empty audit and the digest of nothing.

    Rows are taken by turn, null first; rows of one turn by role, then text. Null ids and turns, roles and texts are
    damaged as one space, a null turn still counts as none. Repeated rows are duplicates. Other columns are not read.
    Rows are shuffled once, by conversation, and sorted on disk where they do not fit; a conversation's digest and audit
    follow from its turns in order, so one conversation is one stream through one task, of which a block is held (and
    a letter per turn, the audit).
    """
    hurt = damage(rows, conv, turn, role, text).repartition("c")
    earlier = Window.partitionBy("c", "gone", "role", "text").orderBy("t")
    seen = F.row_number().over(earlier) > 1
    marked = hurt.withColumn("seen", seen).withColumn("fault", kind_of(F.col("role"), F.col("text"), F.col("seen")))
    ordered = marked.sortWithinPartitions("c", "t", "role", "text", "seen").drop("seen")
    wanted = hurt.schema["c"].dataType
    kind = pa.string() if wanted.typeName() == "string" else pa.int64()
    found = ordered.mapInArrow(_repair(kind), f"c {'string' if wanted.typeName() == 'string' else 'bigint'}, {FIELDS}")
    return found.select(F.col("c").cast(wanted).alias(conv), *[f.split()[0] for f in FIELDS.split(", ")])

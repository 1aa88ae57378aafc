"""The prefix trie of conversations, built as a burst trie.

A container holds the conversations that begin with one sequence of turns. One that has grown too large is burst: its
sequence becomes a trie head and its conversations go on to containers one turn further. Containers that are small
enough are sorted and swept into nodes, each by one task. Whether a container is too large depends on the turns left in
it, as a share of all turns, so the heads of a level never outnumber ``MAX_HEADS`` and can be broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.frames import by_batch, col, stored

#: Turns a container may hold, heads of a level at most, levels a round bursts through.
CONTAINER_TURNS, MAX_HEADS, LEVELS = 20_000, 16_384, 16
#: A conversation's rebuilt opening has fewer turns than this; conversations of one block share an opening.
OPENING, BLOCK = 9, 5

#: Rows of an Arrow batch that are Python objects at a time.
ROWS = 128

ROOT = b""
NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, above array<binary>"
)


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``c``, ``turns``): every conversation's turns in order, each as the digest ``id`` of its role and text and the
    text's ``bytes``. Null turns come first, equal turns by that digest. Texts do not leave the scan."""
    said_by, said = F.coalesce(col(role), F.lit("")), F.coalesce(col(text), F.lit(""))
    one = F.concat(F.octet_length(said_by).cast("string"), F.lit(":"), said_by, said)
    turns = rows.where(col(conv).isNotNull()).select(
        col(conv).alias("c"), F.struct(col(turn).alias("turn"), F.unhex(F.md5(one)).alias("id"), F.octet_length(said).cast("bigint").alias("bytes")).alias("t")
    )
    # an ascending array_sort puts a null field first
    listed = turns.groupBy("c").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("c", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("turns"))


def opening_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % OPENING).cast("int")


def rebuild(listed: DataFrame) -> DataFrame:
    """Every conversation with the opening of its block's first: that one's first turns, then its own after as many."""
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))).alias("own")
    own = listed.withColumn("h", opening_length(F.col("c"))).select("c", (F.col("c") - F.col("c") % BLOCK).alias("base"), "h", own)
    first = listed.select(F.col("c").alias("base"), F.slice("turns", 1, OPENING - 1).alias("first"))
    both = own.join(first, "base", "left")
    opening = F.slice(F.coalesce("first", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    return both.select("c", F.concat(opening, "own").alias("turns"))


def paths(ids: Column) -> Column:
    """A 128-bit digest of each sequence of first turns, the empty one included: equal digests, equal sequences."""

    def run(batches):
        for column in batches:
            ids, made, at = column.flatten().to_pylist(), [], 0
            for n in column.value_lengths().to_pylist():
                path = [ROOT]
                for one in ids[at : at + n]:
                    path.append(hashlib.blake2b(path[-1] + one, digest_size=16).digest())
                made.append(path)
                at += n
            yield pa.array(made, pa.list_(pa.binary()))

    return by_batch(run, "array<binary>", ids)


def sequences(rebuilt: DataFrame) -> DataFrame:
    """(``c``, ``path``, ``bytes``, ``n``): digests of the first 0, 1, .. n turns and the bytes of the last of each."""
    made = rebuilt.select("c", paths(F.col("turns.id")).alias("path"), F.col("turns.bytes").alias("bytes"))
    return made.withColumn("n", F.size("bytes").cast("bigint"))


def burst(seqs: DataFrame, limit: int, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Heads (``path``, ``depth``, ``conv_id``, ``n_convs``, ``bytes``), and per conversation the ``depth`` of its
    container; -1 where it ends at a head.

    A round counts the conversations and turns behind every sequence of up to ``levels`` more turns, combined before
    the shuffle, and follows each conversation through the heads found. Conversations that are still in an oversized
    container at the last of these levels go on to the next round, so the rounds grow with the length of what is shared
    by many, not with the data. The root is always a head.
    """
    heads, placed, left, depth = [], [], seqs, 0
    while True:
        step = F.posexplode(F.slice("path", depth + 1, levels)).alias("i", "p")
        seen = left.select("c", "n", "bytes", step).withColumn("depth", F.col("i") + depth)
        counted = seen.groupBy("p").agg(
            F.min("depth").cast("bigint").alias("depth"),
            F.min("c").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.sum(F.col("n") - F.col("depth")).alias("rest"),
            F.max(F.when(F.col("depth") > 0, F.get("bytes", F.col("depth") - 1)).otherwise(F.lit(0))).alias("bytes"),
        )
        large = ((F.col("n_convs") > 1) & (F.col("rest") > limit)) | (F.col("depth") == 0)
        now = stored(counted.where(large).select(F.col("p").alias("path"), "depth", "conv_id", "n_convs", "bytes"), "trie-heads")
        heads.append(now)
        in_heads = seen.join(F.broadcast(now.select(F.col("path").alias("p"))), "p", "left_semi")
        deepest = in_heads.groupBy("c").agg(F.max("depth").alias("head"))
        found = stored(left.join(deepest, "c", "left").withColumn("head", F.coalesce("head", F.lit(depth - 1))), "trie-round")
        last = depth + levels - 1
        goes_on = (F.col("head") == last) & (F.col("n") > F.col("head"))
        ended = F.col("n") == F.col("head")
        placed.append(found.where(~goes_on).select(*seqs.columns, F.when(ended, F.lit(-1)).otherwise(F.col("head") + 1).alias("depth")))
        left = found.where(goes_on).select(*seqs.columns)
        if left.isEmpty():
            break
        depth += levels
    return functools.reduce(DataFrame.unionByName, heads), functools.reduce(DataFrame.unionByName, placed)


class _Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "ends", "rows")

    def __init__(self):
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.rows = None, []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations sorted by container, path and id, to the containers' nodes in one pass with a stack of open nodes.

    A node is complete when the path leaves it, its parent's smallest conversation only when the parent is; until the
    container's own node is complete its nodes are kept, no more than the container has turns.
    """
    out: list[list] = []
    stack: list[_Node] = []
    now, path, weight, base = None, [], [], 0

    def close(to: int):
        while len(stack) > to:
            node, depth = stack.pop(), base + len(stack)
            saved = node.saved + (node.n - 1) * weight[depth - 1]
            leaves = node.leaves or 1
            ends = (node.ends or hashlib.sha256()).hexdigest()
            own = [node.conv, depth, None, node.n, node.children, leaves, saved, ends, None]
            for row in node.rows:
                row[2] = node.conv
            out.append(own)
            if stack:
                above = stack[-1]
                above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
                above.n, above.children = above.n + node.n, above.children + 1
                above.leaves, above.saved = above.leaves + leaves, above.saved + saved
                above.rows.append(own)
            else:
                own[8] = path[:base]

    for batch in batches:
        for row in itertools.chain.from_iterable(batch.slice(at, ROWS).to_pylist() for at in range(0, len(batch), ROWS)):
            container = row["container"]
            if container != now:
                close(0)
                if len(out) > 10_000:
                    yield _node_batch(out)
                now, base, path, shared = container, row["depth"], [], 0
            else:
                shared = base
                top = min(len(path), len(row["path"]))
                while shared < top and path[shared] == row["path"][shared]:
                    shared += 1
                close(shared - base)
            path, weight = row["path"], row["bytes"]
            stack.extend(_Node() for _ in range(len(path) - base - len(stack)))
            last = stack[-1]
            last.conv = row["c"] if last.conv is None else min(last.conv, row["c"])
            last.n += 1
            if last.ends is None:
                last.ends = hashlib.sha256(str(row["c"]).encode())
            else:
                last.ends.update(b",%d" % row["c"])
    close(0)
    if out:
        yield _node_batch(out)


def _node_batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.binary())]
    names = [f.split()[0] for f in NODE.split(", ")]
    columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
    out.clear()
    return pa.RecordBatch.from_arrays(columns, names=names)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, c) rows sorted by both to one digest of the ids a path, which streams: no list of ids is held."""
    now, digest, done = None, None, []
    for batch in batches:
        found, ids = batch["path"].to_pylist(), batch["c"].to_pylist()
        for path, group in itertools.groupby(zip(found, ids), key=lambda r: r[0]):
            text = ",".join(str(c) for _, c in group).encode()
            if path != now:
                if digest:
                    done.append((now, digest.hexdigest()))
                now, digest = path, hashlib.sha256(text)
            else:
                digest.update(b"," + text)
    if digest:
        done.append((now, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([d for _, d in done])], names=["path", "ends"])


def prefix_trie(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", container_turns: int = CONTAINER_TURNS, levels: int = LEVELS
) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    A conversation c is rebuilt as the first h turns of conversation c - c % 5 (h = crc32(c) % 9) and its own turns
    after its first h. A node is a distinct sequence of first turns: ``conv_id`` (its smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (over its subtree, each node's
    members but one times the bytes of its last text) and ``ends_sha256`` (of the ascending ids that end there).

    Null roles and texts are empty; null turns come first, equal turns are ordered by a digest of role and text;
    repeated rows are repeated turns. Rows without a conversation id belong to none and are left out. A conversation
    without turns after rebuilding is a member of the root; an empty table has no node. Other columns are not read. A
    conversation is held as one row of 16 bytes and a length per turn, whatever its texts; the ids that end at one node
    are hashed in order as they stream through a task.
    """
    seqs = stored(sequences(rebuild(stored(conversations(rows, conv, turn, role, text), "conversations"))), "sequences")
    turns = seqs.agg(F.sum("n").alias("n")).first()["n"] or 0
    heads, placed = burst(seqs, max(container_turns, -(-turns // MAX_HEADS)), levels)

    ended = placed.where("depth < 0").select(F.element_at("path", -1).alias("path"), "c")
    ends = ended.repartition("path").sortWithinPartitions("path", "c").mapInArrow(_ends, "path binary, ends string")

    inside = placed.where("depth >= 0").withColumn("container", F.get("path", "depth")).drop("n")
    swept = inside.repartition("container").sortWithinPartitions("container", "path", "c").mapInArrow(_sweep, NODE)
    swept = stored(swept, "swept")

    # what lies below a head: its containers, and the heads below it
    first = heads.select(F.col("conv_id").alias("c"), F.col("depth").alias("level"), "path", "n_convs", "bytes")
    behind = F.broadcast(first).join(seqs.select("c", F.col("path").alias("sequence")), "c")
    behind = stored(behind.withColumn("above", F.slice("sequence", F.lit(1), F.col("level").cast("int"))).drop("sequence"), "head-paths")
    parents = behind.where("level > 0").groupBy(F.element_at("above", -1).alias("path")).agg(F.count("*").alias("k"))
    roots = swept.where("above is not null")
    children = parents.unionByName(roots.groupBy(F.element_at("above", -1).alias("path")).agg(F.count("*").alias("k")))
    children = children.groupBy("path").agg(F.sum("k").alias("n_children"))
    known = behind.join(children, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved = F.when(F.col("level") > 0, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0)
    gives = known.select(
        F.explode(F.concat("above", F.array("path"))).alias("path"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("l"), saved.alias("s")
    )
    gives = gives.unionByName(roots.select(F.explode("above").alias("path"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s")))
    below = gives.groupBy("path").agg(F.sum("l").cast("bigint").alias("n_leaves"), F.sum("s").cast("bigint").alias("saved_tokens"))

    names = F.broadcast(heads.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    of_heads = known.join(below, "path").join(ends, "path", "left").withColumn("parent", F.try_element_at("above", F.lit(-1)))
    of_heads = of_heads.join(names, "parent", "left").select(
        F.col("c").alias("conv_id"),
        F.col("level").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    nodes = swept.withColumnRenamed("parent_conv_id", "known").withColumn("parent", F.try_element_at("above", F.lit(-1)))
    nodes = nodes.join(names, "parent", "left").withColumn("parent_conv_id", F.coalesce("known", "parent_conv_id"))
    return of_heads.unionByName(nodes.select(of_heads.columns))

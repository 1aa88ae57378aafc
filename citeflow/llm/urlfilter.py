"""URL filter: a trie over reversed host labels and path segments, longest match between allow and block entries."""

from __future__ import annotations

from bisect import insort
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.frames import col, free_name

#: Most rules that one trie may hold (some 100 bytes each); it is sent to every executor.
MAX_RULES = 1_000_000


@dataclass
class Node:
    """Labels (of the host, from its right end) or segments (of the path) to deeper nodes.

    ``path`` is where the path rules of this host begin; ``partial`` holds unfinished last segments, as a rule's path
    is a prefix of characters, not of segments, and ``sizes`` their different lengths, the longest first.
    """

    below: dict[str, "Node"] = field(default_factory=dict)
    path: "Node | None" = None
    partial: dict[str, tuple[str, str]] = field(default_factory=dict)
    sizes: list[int] = field(default_factory=list)


def build_trie(rules: list[tuple[str, str]]) -> Node:
    """``rules`` are (verdict, ``host/path``); of equal rules the first counts."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a trie of more than {MAX_RULES} is not broadcast")
    root = Node()
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r} is neither allow nor block")
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.below.setdefault(label, Node())
        node.path = node.path or Node()
        node, (*whole, last) = node.path, (slash + path).split("/")
        for segment in whole:
            node = node.below.setdefault(segment, Node())
        node.partial.setdefault(last, (verdict, rule))
        if len(last) not in node.sizes:
            insort(node.sizes, len(last), key=lambda size: -size)
    return root


def match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits, by its number of characters; of equally long ones the one with the longer host."""
    best, node = None, root
    for label in [*reversed(host.split(".")), None]:
        if node.path is not None:
            segments, at, k = path.split("/"), node.path, 0
            while at is not None and k < len(segments):
                found = next((at.partial[segments[k][:n]] for n in at.sizes if segments[k][:n] in at.partial), None)
                if found and (best is None or len(found[1]) >= len(best[1])):
                    best = found
                at, k = at.below.get(segments[k]), k + 1
        node = node.below.get(label) if label is not None else None
        if node is None:
            break
    return best


def _matcher(trie: "Broadcast[Node]"):
    def judge(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = [match(trie.value, h, p) or (None, None) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())],
            names=["verdict", "rule"],
        )

    judge.__annotations__ = {"hosts": pa.Array, "paths": pa.Array, "return": pa.Array}
    return F.arrow_udf(judge, "struct<verdict:string,rule:string>")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to each page; existing columns of these names are replaced.

    A rule ``host/path`` fits its host and all subdomains when the URL's path starts with the rule's; the longest wins;
    a URL that no rule fits gets ``default`` and a null rule. A null URL, or one without ``://``, has an empty host and
    path and so gets the default unless a rule has an empty host. Repeated rows are judged alike; no shuffle.
    """
    made = ["host", "path", "rule", "verdict"]
    host, path, hit = free_name(pages, "_host"), free_name(pages, "_path"), free_name(pages, "_hit")
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    judged = pages.select("*", host_of(col(url)).alias(host), path_of(col(url)).alias(path)).select(
        "*", _matcher(trie)(host, path).alias(hit)
    )
    kept = [col(c) for c in pages.columns if c.lower() not in made]
    return judged.select(
        *kept,
        F.col(host).alias("host"),
        F.col(path).alias("path"),
        F.col(hit)["rule"].alias("rule"),
        F.coalesce(F.col(hit)["verdict"], F.lit(default)).alias("verdict"),
    )

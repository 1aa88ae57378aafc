"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text there is one last token of its encoding. It is a vocabulary token that ends the
prefix and that goes together with the last token of the prefix before it, which means that merging the bytes of the
two side by side gives back just these two. A suffix automaton of the vocabulary names the tokens that end at each
byte, so a piece takes one pass; following the last tokens back from the end gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column

from citeflow.llm.frames import by_batch

#: Most pieces, and most token pairs, whose result a Python worker remembers (some 150 bytes each).
REMEMBERED = 600_000

#: Fixed value: where byte-level vocabularies of this kind cut a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same cuts in texts of these characters only, where the standard library's faster classes mean the same.
PLAIN_PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
PLAIN_TEXT = re.compile(r"[\t-\r -~À-ÖØ-öø-ɏ]*").fullmatch


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself where it prints, else one from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_tokens(path: str) -> tuple[dict[bytes, int], dict[str, int], bool]:
    """Tokens as bytes with their ids, special tokens with theirs, and whether ids follow the order of the merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters, special = _byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    made = [tokens[bytes(letters[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
    return tokens, special, made == list(range(256, 256 + len(made)))


class SuffixAutomaton:
    """The smallest automaton of all substrings of the vocabulary.

    A state stands for substrings that occur at the same places; ``link`` leads to the longest suffix that occurs at
    more. Reading a text byte by byte keeps its longest suffix that is a substring of the vocabulary.
    """

    def __init__(self, tokens: dict[bytes, int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}
        for token, number in tokens.items():
            last = 0
            for byte in token:
                last = self._extend(last, byte)
        for token, number in tokens.items():
            state = 0
            for byte in token:
                state = self.next[state][byte]
            ends.setdefault(state, []).append((len(token), number))
        self.own = {state: sorted(found, reverse=True) for state, found in ends.items()}
        self.places, self.numbers, self.ending = [(0, 0)], {(0, 0): 0}, [[]]
        self.moves: dict[int, int] = {}

    def _copy(self, p: int, byte: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(byte) == q:
            self.next[p][byte] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, byte: int) -> int:
        if byte in self.next[last]:
            q = self.next[last][byte]
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, byte, q)
        state, p = len(self.next), last
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while p >= 0 and byte not in self.next[p]:
            self.next[p][byte] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][byte]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._copy(p, byte, q)
        return state

    def move(self, place: int, byte: int) -> int:
        """Read one byte from a place; computed once, then found in ``moves``.

        A place is a state with the length of the suffix matched there, as a state's strings differ in length.
        ``ending`` lists for each place the (length, id) of the tokens that end there, longest first.
        """
        state, length = self.places[place]
        while state and byte not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        state = self.next[state].get(byte, 0)
        length = length + 1 if state else 0
        to = self.numbers.get((state, length))
        if to is None:
            to = self.numbers[state, length] = len(self.places)
            self.places.append((state, length))
            found, at = [], state
            while at > 0:
                found += [(size, token) for size, token in self.own.get(at, ()) if size <= length]
                at = self.link[at]
            self.ending.append(found)
        self.moves[place << 8 | byte] = to
        return to


class ByteBpe:
    """Encoder and decoder for a byte-level vocabulary file of the ``tokenizers`` library (``tokenizer.json``)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], _byte_letters()
        if spec["normalizer"] or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        as_bytes = lambda token: bytes(letters[c] for c in token)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in special}
        self.parts = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in special.items()}
        self.special = special
        split = "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))
        self.split_special = regex.compile(f"({split})").split if special else None
        self.split = regex.compile(pattern).findall
        self.split_plain = re.compile(PLAIN_PATTERN).findall if pattern == PATTERN else self.split
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (as_bytes(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.made = {new: (rank, *pair) for pair, (rank, new) in self.ranks.items()}
        reachable = {t: i for t, i in self.ids.items() if self.merged([self.ids[bytes([b])] for b in t]) == [i]}
        self.automaton = SuffixAutomaton(reachable)
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """Plain merging by rank, for the few bytes of one token or of two."""
        ids = list(ids)
        while len(ids) > 1:
            best = min((self.ranks.get(p, (1 << 60, 0))[0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            k = best[1]
            ids[k : k + 2] = [self.ranks[ids[k], ids[k + 1]][1]]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Do these two tokens stay two when their bytes are merged side by side?

        The merges inside both are undone, latest first. Between two undone merges a fixed pair of parts meets at the
        border; the tokens stay apart when no such pair would have merged in its time. Of two equal ranks the one
        further left goes first.
        """
        ranks, made = self.ranks, self.made
        time = 1 << 60
        first = False  # may the border pair merge at ``time`` itself, being left of what merged then?
        while True:
            rank = ranks.get((left, right))
            if rank is not None and (rank[0] < time or first and rank[0] == time):
                return False
            undo_left, undo_right = made.get(left), made.get(right)
            if undo_left is None and undo_right is None:
                return True
            if undo_left is None or undo_right is not None and undo_right[0] >= undo_left[0]:
                time, right, first = undo_right[0], undo_right[1], True
            else:
                time, left, first = undo_left[0], undo_left[2], False

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of text between the cuts of the pattern."""
        moves, ending, pairs = self.automaton.moves, self.automaton.ending, self.pairs
        tokens, sizes = [-1], [0]
        place = 0
        for end, byte in enumerate(piece, 1):
            to = moves.get(place << 8 | byte)
            place = self.automaton.move(place, byte) if to is None else to
            for size, token in ending[place]:
                before = tokens[end - size]
                if before < 0:
                    break
                fits = pairs.get(before << 32 | token)
                if fits is None:
                    fits = self.compatible(before, token)
                    if len(pairs) < REMEMBERED:
                        pairs[before << 32 | token] = fits
                if fits:
                    break
            else:
                raise ValueError("no token ends here: the vocabulary lacks a byte")
            tokens.append(token)
            sizes.append(size)
        ids, end = [], len(piece)
        while end:
            ids.append(tokens[end])
            end -= sizes[end]
        return ids[::-1]

    def _remember(self, piece: str) -> bytes:
        packed = np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()
        if len(self.known) < REMEMBERED and len(piece) <= 64:
            self.known[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers; null and empty give none."""
        if not text:
            return b""
        known, remember, out = self.known.get, self._remember, []
        for part in self.split_special(text) if self.split_special else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            else:
                split = self.split_plain if PLAIN_TEXT(part) else self.split
                out += [known(piece) or remember(piece) for piece in split(part)]
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        parts = self.parts
        return b"".join([parts[i] for i in np.frombuffer(packed, dtype="<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """The encoder of a vocabulary file, built once in each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def encode(text: Column, path: str, pattern: str) -> Column:
    """Array of token ids of each text; ``path`` must name the vocabulary file on every executor."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path, pattern)
        for texts in batches:
            rows = [np.frombuffer(bpe.encode(t.as_py()), dtype="<u4").astype(np.int32) for t in texts]
            yield pa.array(rows, pa.list_(pa.int32()))

    return by_batch(run, "array<int>", text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Text of each array of token ids; null for null. Bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path, pattern)
        for rows in batches:
            texts = [None if r is None else bpe.decode(np.array(r, dtype="<u4").tobytes()) for r in rows.to_pylist()]
            yield pa.array(texts, pa.string())

    return by_batch(run, "string", ids)


def round_trip_digests(text: Column, path: str, pattern: str) -> Column:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text, encoded and decoded by one pass over it."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path, pattern)
        for texts in batches:
            counts, ids, decoded = [], [], []
            for t in texts:
                packed = bpe.encode(t.as_py())
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(packed).encode()).hexdigest())
            columns = [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.StructArray.from_arrays(columns, names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return by_batch(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>", text)

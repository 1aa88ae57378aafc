"""Secret scan: keyword automaton first, regular expressions anchored at its hits, embedded checksums last."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.llm.frames import by_batch, col, free_name

#: The order in which kinds are listed where two spans start at the same place.
KINDS = ("assign", "access", "hex", "github", "npm", "pem", "card")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
_PEM_END = re.compile(r"-----END ([A-Z ]*PRIVATE KEY)(?=-----)")
_CARD = re.compile(r"(?<![0-9])[3-6][0-9]{12,18}(?![0-9])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """The six base-62 digits of a body's CRC-32, as GitHub and npm tokens carry them at their end."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = _BASE62[digit] + digits
    return digits


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _carries_checksum(found: re.Match) -> bool:
    body = found[0].partition("_")[2]
    return checksum62(body[:-6]) == body[-6:]


#: keyword (lower case) -> kind, expression that must match where the keyword begins, test of the match.
ANCHORED = {
    **{
        word: ("assign", _ASSIGN, lambda m: len(m[2]) >= 6)
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key")
    },
    "akia": ("access", _ACCESS, lambda m: len(m[0]) >= 20),
    **{f"gh{c}_": ("github", _GITHUB, _carries_checksum) for c in "pousr"},
    "npm_": ("npm", _NPM, _carries_checksum),
    "-----begin ": ("pem", _PEM, lambda m: True),
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ANCHORED:
        found.add_word(word, word)
    found.make_automaton()
    return found


_AUTOMATON = _automaton()
_UPPER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, every other character kept, so that positions stay."""
    low = text.lower()
    return low if text.isascii() or len(low) == len(text) else text.translate(_UPPER)


class _KeyEnds:
    """Where the private keys of a text may end, found in one pass when the first one begins."""

    def __init__(self, text: str):
        self.text, self.starts = text, None

    def after(self, label: str, at: int) -> int | None:
        """End of the first closing line with this label that begins at ``at`` or later."""
        if self.starts is None:
            self.starts = {}
            for found in _PEM_END.finditer(self.text, at):
                self.starts.setdefault(found[1], []).append(found.start())
        starts = self.starts.get(label, [])
        k = bisect_left(starts, at)
        return starts[k] + len(f"-----END {label}-----") if k < len(starts) else None


def scan_text(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets by start, then kind as listed; code points, end exclusive; none for null.

    Per kind, matches are taken from the left without overlap; one whose test fails still uses up its characters.
    Runs of hexadecimal digits and card numbers have no keyword that could stand before them: one pass of an expression
    over the text finds them.
    """
    if not text:
        return []
    spans, ends, keys = [], dict.fromkeys(KINDS, 0), _KeyEnds(text)
    for last, word in _AUTOMATON.iter(ascii_lower(text)):
        start = last + 1 - len(word)
        kind, expression, valid = ANCHORED[word]
        if start >= ends[kind] and (found := expression.match(text, start)):
            end = keys.after(found[1], found.end()) if kind == "pem" else found.end()
            if end is None:
                continue
            ends[kind] = end
            if valid(found):
                spans.append((kind, start, end))
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    spans += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if luhn(m[0])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def redact_text(text: str | None) -> str | None:
    """The text with each secret replaced by ``[kind]``; of overlapping spans the first names the whole stretch."""
    out, at, union = [], 0, []
    for kind, start, end in scan_text(text):
        if union and start < union[-1][2]:
            union[-1][2] = max(union[-1][2], end)
        else:
            union.append([kind, start, end])
    for kind, start, end in union:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]]) if union else text


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = ([{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t.as_py())] for t in texts)
        yield pa.array(list(rows), _SPANS)


def _redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([redact_text(t.as_py()) for t in texts], pa.string())


def scan_secrets(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add the array ``spans`` of (kind, start, end) to each row; null and empty texts have an empty array.

    Texts are scanned whole, row by row, without a shuffle; repeated rows get equal spans. An existing column of that
    name is replaced.
    """
    kept = [col(c) for c in docs.columns if c.lower() != spans.lower()]
    return docs.select(*kept, by_batch(_scan, "array<struct<kind:string,start:bigint,end:bigint>>", col(text)).alias(spans))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace each secret in the text by ``[kind]``; other columns and rows stay, null text stays null."""
    name = free_name(docs, "_redacted")
    done = docs.select("*", by_batch(_redact, "string", col(text)).alias(name))
    return done.select(*[F.col(name).alias(c) if c == text else col(c) for c in docs.columns])

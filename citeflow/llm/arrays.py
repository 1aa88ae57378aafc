"""Whole Arrow string columns as NumPy arrays: words, their 64-bit identities and shingles, without a Python loop per word.

Every function takes a slice of texts at a time (``text_slices``), so memory follows the slice and the longest text in
it, not the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
_STEP = 0xD1342543DE82EF95
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(letters: bool) -> np.ndarray:
    """A 64-bit value per byte, A-Z as a-z, zero for what separates words."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIERS[0])
    values[65:91] = values[97:123]
    for b in range(256):
        if (b < 128 and not chr(b).isalpha()) if letters else b in SPACES:
            values[b] = 0
    return values


WORD_VALUES, LETTER_VALUES = _byte_values(False), _byte_values(True)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for step in (_STEP, _STEP_BACK):
            out = np.full(max(n, SLICE_BYTES + 1), step, dtype=np.uint64)
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers[0], _powers[1]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of texts of about ``size`` bytes; a longer text makes a run of its own."""
    offsets, data = strings(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


class Words:
    """The words of some texts: byte ``starts`` and ``stops``, and where each text's words begin (``begins``, one more
    entry at the end).

    Words are what lies between white space (``letters``: between everything but letters), A-Z as a-z. The identity of
    a stretch of bytes is a polynomial of the bytes, evaluated for all stretches at once from running sums.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, letters: bool = False):
        values = (LETTER_VALUES if letters else WORD_VALUES)[data]
        inside = values != 0
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts = np.flatnonzero(first)
        self.stops = np.flatnonzero(last) + 1
        self.begins = np.searchsorted(self.starts, offsets)
        forward, self._back = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values * forward[: len(data)], out=self._sums[1:])

    def hashes(self, at_most: int | None = None) -> np.ndarray:
        """64-bit identities of the words, or of their first bytes."""
        stops = self.stops if at_most is None else np.minimum(self.stops, self.starts + at_most)
        return mix((self._sums[stops] - self._sums[self.starts]) * self._back[self.starts])


def shingle_hashes(words: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles of each text, ascending, and where each text's begin.

    A text of fewer words has its whole word sequence as one shingle; a text without words has none.
    """
    counts = np.diff(begins)
    grams = np.zeros(len(words), dtype=np.uint64)
    for i in range(min(n, len(words))):
        place = (int(_MULTIPLIERS[i % 4]) * (i + 1)) % (1 << 64)
        grams[: len(words) - i] += mix(words[i:] + np.uint64(place))
    grams = mix(grams)
    pieces, sizes = [], []
    for k, count in enumerate(counts):
        at = begins[k]
        if count >= n:
            piece = np.sort(grams[at : at + count - n + 1])
            keep = np.empty(len(piece), dtype=bool)
            keep[0] = True
            np.not_equal(piece[1:], piece[:-1], out=keep[1:])
            piece = piece[keep]
        elif count:
            short = int(count)
            for word in words[at : at + count].tolist():
                short = (short * int(_MULTIPLIERS[1]) + word) % (1 << 64)
            piece = mix(np.array([short], dtype=np.uint64))
        else:
            piece = grams[:0]
        pieces.append(piece)
        sizes.append(len(piece))
    return (np.concatenate(pieces) if pieces else grams[:0]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

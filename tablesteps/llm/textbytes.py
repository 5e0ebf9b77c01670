"""Words, lines and hashes of whole Arrow batches of texts, computed on their UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D. These separators are
ASCII, so a run of bytes is a run of code points. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20  # texts are worked on in slices of about this size; one text is never cut


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (an invertible finaliser, so distinct values stay distinct)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_PLACE = mix(np.arange(101, 165, dtype=U64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n; only the largest table is kept."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, U64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers[size] = tuple(tables)
    return _powers[size]


class Texts:
    """A slice of texts: ``data`` holds their bytes, text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.size = len(offsets) - 1

    def lowered(self) -> Texts:
        """The same texts with A-Z as a-z."""
        return Texts(_LOWER[self.data], self.offsets)

    def _runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of set bytes; a run never crosses two texts."""
        first = np.zeros(len(inside) + 1, bool)
        first[self.offsets] = True
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:-1]
        ends[:-1] &= ~inside[1:] | first[1:-1]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, bounds): word w is data[starts[w]:ends[w]]; text i has bounds[i]:bounds[i + 1]."""
        starts, ends = self._runs(~_SEPARATOR[self.data])
        return starts, ends, np.searchsorted(starts, self.offsets)

    def runs(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, bounds) of the runs of bytes that a table of 256 booleans marks."""
        starts, ends = self._runs(kinds[self.data])
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, bounds) of the non-empty lines between line feeds."""
        starts, ends = self._runs(self.data != 0x0A)
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each range of bytes, from running sums of a polynomial."""
        up, down = _power_tables(max(1, len(self.data)))
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_CODES[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))

    def code_points_before(self) -> np.ndarray:
        """How many code points start before each byte."""
        before = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=before[1:])
        return before


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) of a string column, a null text being empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, len(column))
        yield row, end, Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def shingles(texts: Texts, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the ``words``-word shingles of each text.

    A text with fewer words has its whole sequence as one shingle, one without words none.
    """
    texts = texts.lowered()
    starts, ends, bounds = texts.words()
    hashed = texts.hashes(starts, ends)
    windows = np.zeros(max(0, len(hashed) - words + 1), U64)
    for j in range(words):
        windows += hashed[j : j + len(windows)] * (_WORD_PLACE[j] | U64(1))
    windows = mix(windows)
    for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = end - first
        if n >= words:
            yield np.unique(windows[first : end - words + 1])
        elif n:
            yield mix((hashed[first:end] * (_WORD_PLACE[:n] | U64(1))).sum(keepdims=True) + _WORD_PLACE[63] + U64(n))
        else:
            yield np.zeros(0, U64)

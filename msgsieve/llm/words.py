"""Words of whole texts and hashes of word sequences, vectorised over Arrow columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Texts are taken in blocks of
about a megabyte and a few thousand rows, so the arrays stay small however many rows an
Arrow batch has and however short they are; a longer text is a block of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 2048

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
# For comparison that ignores case and ASCII punctuation: other bytes separate words.
_PLAIN = _SEPARATOR.copy()
_PLAIN[:0x80] = True
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _PLAIN[_low:_high] = False

WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def release_memory() -> None:
    """Give freed memory back to the system: an idle worker shares its executor with later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only this C library has it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits; one-to-one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(size: int) -> np.ndarray:
    global _powers
    if len(_powers) < size:
        table = np.full(max(size, 4096), WORD_BASE, dtype=np.uint64)
        table[0] = 1
        _powers = np.cumprod(table, dtype=np.uint64)
    return _powers


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and the rows' offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and BLOCK_ROWS rows, or of one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), low + BLOCK_ROWS, rows)
        yield low, high
        low = high


class Words:
    """The words of a block of rows.

    ``start`` and ``end`` are byte positions in ``data``; the words of row ``r`` are
    ``first[r]`` up to ``first[r + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, plain: bool = False):
        base = int(offsets[0])
        data = data[base : int(offsets[-1])]
        bounds = offsets - base
        if lower:
            data = _LOWER[data]
        inside = ~(_PLAIN if plain else _SEPARATOR)[data]
        begins, stops = inside.copy(), inside.copy()
        if len(data):
            edge = bounds[(bounds > 0) & (bounds < len(data))]
            joined = inside[:-1].copy()
            joined[edge - 1] = False  # the byte before a row's first belongs to another row
            begins[1:] &= ~joined
            joined = inside[1:].copy()
            joined[edge - 1] = False
            stops[:-1] &= ~joined
        self.data = data
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, bounds)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        length = self.end - self.start
        total = np.cumsum(length)
        begin = total - length
        place = np.arange(int(total[-1])) - np.repeat(begin, length)
        value = self.data[place + np.repeat(self.start, length)].astype(np.uint64) + np.uint64(1)
        table = _power_table(min(int(length.max()), 65536))
        if int(length.max()) > 65536:
            value *= (2 * (place >> 16) + 1).astype(np.uint64)
            place &= 65535
        value *= table[place]
        return mix(np.add.reduceat(value, begin) + length.astype(np.uint64))

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self, low: int, high: int, keep: np.ndarray | None = None) -> bytes:
        """Words ``low`` to ``high`` joined by single spaces, only those marked in ``keep``."""
        raw = self.data.tobytes()
        chosen = range(low, high) if keep is None else low + np.flatnonzero(keep)
        return b" ".join([raw[self.start[i] : self.end[i]] for i in chosen])


def sequence_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of ``words[i : i + size]`` for every ``i`` for which there are that many.

    Sequences of doubling length are combined, so the work is a few passes.
    """
    factor = np.uint64(base | 1)
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, length, done, result = words, 1, 0, None
    with np.errstate(over="ignore"):
        scale = factor
        while True:
            if size & length:
                part = power[done : done + count]
                result = part.copy() if result is None else result * scale + part
                done += length
            if done == size:
                return mix(result)
            power = power[:-length] * scale + power[length:]
            length *= 2
            scale = scale * scale


def valid_starts(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of ``total`` starting words have ``size`` words in their own row."""
    rows = np.repeat(first[1:], np.diff(first))[:total]
    return np.arange(total) + size <= rows


def as_signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, in a few passes over doubling widths."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Joined:
    """The chosen words of every row of a block, joined by single spaces."""

    def __init__(self, words: Words, keep: np.ndarray | None = None):
        low, high = words.start, words.end
        owner = words.rows()
        if keep is not None:
            low, high, owner = low[keep], high[keep], owner[keep]
        length = high - low + 1  # with the space after it
        total = np.cumsum(length)
        begin = total - length
        size = int(total[-1]) if len(total) else 0
        place = np.arange(size) + np.repeat(low - begin, length)
        data = words.data[np.minimum(place, len(words.data) - 1)] if size else np.zeros(0, np.uint8)
        data[total - 1] = 0x20
        self._raw = data.tobytes()
        first = np.searchsorted(owner, np.arange(len(words.first)))
        self._bounds = np.concatenate([[0], total])[first].tolist()

    def row(self, r: int) -> bytes:
        low, high = self._bounds[r], self._bounds[r + 1]
        return self._raw[low : high - 1] if high > low else b""

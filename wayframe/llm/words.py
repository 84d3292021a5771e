"""Words of whole texts as 64-bit hashes, in numpy over the bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space, the bytes 0x20 and 0x09-0x0D.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)

MULTIPLY_A = np.uint64(0x9E3779B97F4A7C15)
MULTIPLY_B = np.uint64(0xD6E8FEB86659FD93)
SLICE = 1 << 20


def separators(values: tuple[int, ...] = WHITE) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over all bits; a one-to-one function."""
    x = x ^ (x >> np.uint64(32))
    x *= MULTIPLY_A
    x ^= x >> np.uint64(29)
    x *= MULTIPLY_B
    x ^= x >> np.uint64(32)
    return x


def joined(left: np.ndarray, right: np.ndarray, salt: int = 0) -> np.ndarray:
    """Name of an ordered pair of names."""
    return mix(mix(left + np.uint64(0x632BE59BD9B4E019 + salt)) * np.uint64(3) + right)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of several texts: ``hash``, first and end byte of each word, and ``of``: the first word of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
        parts = [self._slice(raw, offsets, lo, hi, separator) for lo, hi in _slices(raw, offsets, separator)]
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.hash, self.start, self.end = (np.concatenate(x) for x in zip(*(parts or [empty])))
        self.of = np.searchsorted(self.start, offsets)
        self.raw, self.offsets = raw, offsets

    @staticmethod
    def _slice(raw, offsets, lo, hi, separator):
        inside = ~separator[raw[lo:hi]]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        first[edges] = inside[edges]
        at = np.flatnonzero(inside)
        begins = np.flatnonzero(first)
        if not len(begins):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.searchsorted(at, begins)
        size = np.diff(np.append(cut, len(at)))
        place = at - np.repeat(begins, size)
        value = mix((place.astype(np.uint64) << np.uint64(8)) + raw[lo:hi][at] + np.uint64(1))
        return mix(np.add.reduceat(value, cut) + size.astype(np.uint64)), begins + lo, begins + lo + size

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def owner(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.of) - 1), self.counts())


def _slices(raw, offsets, separator):
    """Ranges of about SLICE bytes that cut no word."""
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(n, lo + SLICE)
        while hi < n:
            k = np.searchsorted(offsets, hi)
            edge = offsets[k] if k < len(offsets) else n
            ahead = separator[raw[hi : min(edge, hi + SLICE)]]
            if ahead.any():
                hi += int(ahead.argmax())
                break
            if edge <= hi + SLICE:
                hi = int(edge)
                break
            hi += SLICE
        yield lo, hi
        lo = hi


def window_hashes(names: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Name of the ``width`` names from each place on; one per place that has so many."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, done, out = names, 1, 0, None
    while True:
        if width & size:
            part = power[done : done + n]
            out = joined(out, part, salt) if out is not None else part.copy()
            done += size
        size *= 2
        if size > width:
            return out
        power = joined(power[: len(power) - size // 2], power[size // 2 :], salt)

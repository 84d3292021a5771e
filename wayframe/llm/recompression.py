"""Recompression of word sequences: rounds that name runs and pairs of symbols, the same way everywhere.

A round splits the symbols by a bit of their names into left and right ones. A run of equal symbols becomes one
symbol, and so does a run of a left symbol followed by a run of a right one. Names are hashes of the round and the
parts, so every task gives equal parts one global name. Whether two neighbours join depends on these two alone; so
each symbol has a context, the words that settle it, and equal texts have equal symbols wherever the contexts lie
within the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import joined, mix


@dataclass
class Symbols:
    """Names of the symbols of a round, first and end word of each, first and end word of each context."""

    name: np.ndarray
    first: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    owner: np.ndarray


def words_as_symbols(names: np.ndarray, owner: np.ndarray) -> Symbols:
    at = np.arange(len(names))
    return Symbols(names, at, at + 1, at, at + 1, owner)


def next_round(s: Symbols, turn: int) -> Symbols:
    """Runs and pairs joined once. At an end of its text a symbol's context has one word beyond, so no window holds it."""
    n = len(s.name)
    if not n:
        return s
    right = (mix(s.name + np.uint64(turn * 0x1F123BB5 + 1)) & np.uint64(1)).astype(bool)
    near = s.owner[1:] == s.owner[:-1]
    equal = near & (s.name[1:] == s.name[:-1])
    join = equal | (near & ~right[:-1] & right[1:])
    first = np.flatnonzero(np.append(True, ~join))
    last = np.append(first[1:], n) - 1
    # names: runs get name and length, then the run of a left symbol joins the run of a right one
    run = np.flatnonzero(np.append(True, ~equal))
    length = np.diff(np.append(run, n))
    runs = np.where(length > 1, joined(s.name[run], length.astype(np.uint64), 2 * turn + 1), s.name[run])
    at = np.searchsorted(run, first)
    two = np.append(at[1:], len(run)) - at == 2
    name = runs[at].copy()
    name[two] = joined(runs[at[two]], runs[at[two] + 1], 2 * turn + 2)
    # the neighbours outside tell that the symbol goes no further
    low, high = s.first[first] - 1, s.end[last] + 1
    inner = first > 0
    inner[inner] = near[first[inner] - 1]
    low[inner] = s.low[first[inner] - 1]
    outer = last < n - 1
    outer[outer] = near[last[outer]]
    high[outer] = s.high[last[outer] + 1]
    return Symbols(name, s.first[first], s.end[last], low, high, s.owner[first])


def rounds(names: np.ndarray, owner: np.ndarray, count: int) -> list[Symbols]:
    out = [words_as_symbols(names, owner)]
    for turn in range(count):
        out.append(next_round(out[-1], turn))
    return out

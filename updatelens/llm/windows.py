"""Runs of windows that share their least q-gram.

A window is ``length`` consecutive symbols. Equal windows have equal least q-grams, so neighbouring
windows with the same least q-gram form a run, and a table of runs is many times shorter than the
text. Two windows can only be equal if their runs carry the same q-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20  # windows looked at together; a run ends with its block

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MORE
    h ^= h >> _SHIFT
    return h * _ODD


def gram_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` symbols from every position; ``size`` is a power of two."""
    h = _mixed(symbols.astype(np.uint64) + _ODD)
    step = 1
    while step < size:
        h = _mixed(h[:-step] * _ODD + (h[step:] ^ (h[step:] >> _SHIFT)))
        step *= 2
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _twice(h: np.ndarray, least: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Which runs have their least q-gram at two places, so that a window may repeat inside the run."""
    edge = np.zeros(width - 1, h.dtype)
    highest = np.concatenate((edge, least, edge))
    highest = ~sliding_least(~highest, width)  # the highest least of the windows over each place
    places = np.flatnonzero(h == highest)
    same = np.flatnonzero((h[places[1:]] == h[places[:-1]]) & (np.diff(places) <= width))
    out = np.zeros(len(first), bool)
    for k in same.tolist():
        i, j = places[k], places[k + 1]
        low = np.searchsorted(first, max(0, j - width), "right") - 1
        high = np.searchsorted(first, min(i, len(least) - 1), "right") - 1
        for run in range(low, high + 1):
            out[run] |= bool(least[first[run]] == h[i])
    return out


def runs(symbols: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every block of windows, per run: the q-gram, first and last window, whether it may repeat inside."""
    windows = len(symbols) - length + 1
    for at in range(0, windows, BLOCK):
        part = symbols[at : min(at + BLOCK, windows) + length - 1]
        h = gram_hashes(part, gram)
        width = length - gram + 1
        least = sliding_least(h, width)
        first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [len(least) - 1]))
        yield least[first].view(np.int64), first + at, last + at, _twice(h, least, first, width)

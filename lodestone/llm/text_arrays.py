"""Words and lines of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SEED = np.random.default_rng(20240229)
#: A random 64-bit value for each byte and an odd multiplier: the hash of a run of bytes is sum(value[byte] * multiplier^place).
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(_SEED.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1024)
        _POWERS = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size - 1, _STEP, np.uint64))))
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def byte_set(pattern: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(pattern)] = True
    return out


#: What ends a word of the pattern [^\x20\x09-\x0D]+.
WHITE = byte_set(b" \t\n\x0b\x0c\r")


@dataclass
class Runs:
    """Maximal runs of bytes between separators; none crosses the end of a row."""

    row: np.ndarray
    start: np.ndarray
    size: np.ndarray
    hash: np.ndarray
    inside: np.ndarray  # for each byte, whether it is in a run


def runs(raw: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> Runs:
    """``raw`` holds the rows that ``bounds`` (from 0) cuts."""
    inside = ~separators[raw]
    n = len(raw)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    heads = bounds[:-1][bounds[:-1] < n]
    before[heads] = False
    start = np.flatnonzero(inside & ~before)
    row = np.searchsorted(bounds, start, "right") - 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, np.zeros(0, np.uint64), inside)
    size = np.add.reduceat(inside, start, dtype=np.int64)
    body = raw[inside]
    first = np.cumsum(size) - size
    place = np.arange(len(body)) - np.repeat(first, size)
    value = _BYTE[body] * powers(int(size.max()))[place]
    return Runs(row, start, size, mix(np.add.reduceat(value, first) ^ size.astype(np.uint64)), inside)


def windows(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``n`` runs within a row, and the index of its first run."""
    last = len(hashes) - n + 1
    if last <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(last, np.uint64)
    for k in range(n):
        total = (total + hashes[k : k + last]) * _STEP
    first = np.flatnonzero(row[:last] == row[n - 1 :])
    return mix(total[first]), first

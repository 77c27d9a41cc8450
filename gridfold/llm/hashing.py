"""Vectorised hashing of spans of a byte array: words, windows of words, and character n-grams."""

from __future__ import annotations

import numpy as np

from gridfold.llm.common import IS_SPACE

PRIME, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a prime and of its inverse, modulo 2 to the 64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((PRIME, INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block of texts, and ``cuts``: text i has words cuts[i] to cuts[i + 1]."""
    solid = ~IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = solid[first]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[first[1:] - 1] = solid[first[1:] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes that depend on a span's bytes alone."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Of every window of ``size`` hashes in a row, in order; windows may span texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out = out * PRIME + hashes[j : j + n]
    return mixed(out)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a block of texts, and the offsets of the texts among them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    return points, begins[offsets]


def ngram_slots(data: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Slots of all n-grams of code points (or bytes); the last ``size - 1`` places have none."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    wide = data.astype(np.uint32)
    out = wide[:n].copy()
    for j in range(1, size):
        out *= np.uint32(0x01000193)
        out += wide[j : j + n]
    out *= np.uint32(0x9E3779B1 + 2 * size)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return (out >> np.uint32(32 - bits)).astype(np.int32)


def spread(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values from begin to end, for each pair; empty ranges give 0."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    end = np.minimum(np.maximum(begin, end), len(values))
    return sums[end] - sums[np.minimum(begin, len(values))]

"""Fast similarity sketching of sets, for many rows at once.

A sketch has ``t`` coordinates. In round i < t every element is thrown into a
random bin with a random value, behind all values of earlier rounds; in round
t + b every element is thrown into bin b. A row stops after the first round
that leaves no bin empty, which the last t rounds guarantee. Coordinates of
two sets agree with the probability of their Jaccard similarity, with the
concentration of t independent ones, in O(t log t + n) per row.
"""

from __future__ import annotations

import numpy as np

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around on purpose."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP)


def fast_similarity_sketch(elements: np.ndarray, rows: np.ndarray, n_rows: int, t: int) -> np.ndarray:
    """``elements`` (uint64 hashes) of ``rows``; an (n_rows, t) uint64 matrix.

    Rows without elements keep EMPTY in every coordinate.
    """
    out = np.full(n_rows * t, EMPTY, dtype=np.uint64)
    e, r = elements.astype(np.uint64), rows.astype(np.int64)
    low, seeds = np.uint64(0xFFFFFFFF), _seeds(2 * t)
    for i in range(2 * t):
        if not len(e):
            break
        h = mix(e ^ seeds[i])
        bins = ((h >> np.uint64(32)) % np.uint64(t)).astype(np.int64) if i < t else i - t
        value = (np.uint64(i) << np.uint64(32)) | (h & low)
        np.minimum.at(out, r * t + bins, value)
        if i + 1 < 2 * t:
            short = (out.reshape(n_rows, t) == EMPTY).any(axis=1)
            keep = short[r]
            e, r = e[keep], r[keep]
    return out.reshape(n_rows, t)

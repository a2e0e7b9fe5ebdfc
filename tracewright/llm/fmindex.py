"""An FM-index over a sequence of small integers, built and searched with numpy."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of any symbol in any prefix of a sequence, for many queries at once."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq
        for level in range(bits - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            ones = np.zeros(len(cur) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def rank(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before ``lo`` and before ``hi``."""
        start = np.zeros_like(lo)
        for k in range(self.bits):
            bit = (symbols >> (self.bits - 1 - k)) & 1 == 1
            ones, zeros = self.ones[k], self.zeros[k]
            at = [ones[x] for x in (start, lo, hi)]
            start, lo, hi = (np.where(bit, zeros + o, x - o) for x, o in zip((start, lo, hi), at))
        return lo - start, hi - start


def suffix_array(seq: np.ndarray, bits: int) -> np.ndarray:
    """Positions in the order of their suffixes; the sequence must end in its only 0.

    The first sort compares as many symbols as fit into 62 bits; each further
    round doubles the length compared and only touches suffixes still tied.
    """
    n = len(seq)
    width = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([seq.astype(np.int64), np.zeros(width, dtype=np.int64)])
    for i in range(width):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    start = np.flatnonzero(new)
    group = np.repeat(start, np.diff(np.append(start, n)))  # first row of each row's group of ties
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = group
    rank[n] = -1
    h = width
    while h < n:
        size = np.diff(np.append(start, n))
        tied = np.repeat(size > 1, size)
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        pos = order[rows]
        behind = rank[np.minimum(pos + h, n)]
        sub = np.lexsort((pos, behind, group[rows]))
        order[rows] = pos[sub]
        g, b = group[rows][sub], behind[sub]
        new = np.ones(n, dtype=bool)
        same = np.zeros(len(rows), dtype=bool)
        same[1:] = (g[1:] == g[:-1]) & (b[1:] == b[:-1])
        new[rows] = ~same
        start = np.flatnonzero(new)
        group = np.repeat(start, np.diff(np.append(start, n)))
        rank[order] = group
        h *= 2
    return order


class FMIndex:
    """Backward search and location over ``seq``; 0 is the end mark between texts.

    Every ``sample``-th position of the sequence is kept; any other occurrence
    is located by stepping back through the transform until a kept one is met.
    """

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 8):
        # Internally one higher, so that the mark at the very end is alone in being 0.
        seq = np.append(seq.astype(np.int64) + 1, 0)
        n_symbols += 1
        bits = int(n_symbols).bit_length()
        sa = suffix_array(seq, bits)
        self.n = len(seq)
        self.bwt = seq[sa - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols + 1))]).astype(np.int64)
        self.ranks = WaveletMatrix(self.bwt, bits)
        kept = sa % sample == 0
        self.kept = np.zeros(self.n + 1, dtype=np.int32)
        np.cumsum(kept, out=self.kept[1:])
        self.places = sa[kept]

    def search(self, patterns: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the patterns, an (m, k) matrix of symbols > 0; only of some ``rows`` of it if given."""
        rows = np.arange(len(patterns)) if rows is None else rows
        m, k = len(rows), patterns.shape[1]
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, self.n, dtype=np.int64)
        live = np.arange(m)
        for i in range(k - 1, -1, -1):
            c = patterns[rows[live], i].astype(np.int64) + 1
            a, b = self.ranks.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.starts[c] + a, self.starts[c] + b
            gone = live[a == b]
            hi[gone] = lo[gone]
            live = live[b > a]
            if not len(live):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows of the transform."""
        rows, steps = rows.astype(np.int64), np.zeros(len(rows), dtype=np.int64)
        out = np.empty(len(rows), dtype=np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = rows[live]
            hit = self.kept[here + 1] > self.kept[here]
            done = live[hit]
            out[done] = self.places[self.kept[rows[done]]] + steps[done]
            live = live[~hit]
            if len(live):
                here = rows[live]
                c = self.bwt[here]
                before, _ = self.ranks.rank(c, here, here)
                rows[live] = self.starts[c] + before
                steps[live] += 1
        return out

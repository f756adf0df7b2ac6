"""An FM-index over integer sequences in numpy: suffix order, wavelet-tree
ranks, backward search and locating by sampled suffix positions.

Symbol 0 separates runs. Every separator counts as smaller than any symbol and
as different from the others, so no comparison and no occurrence crosses one.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks of any symbol before any place, level by level from the top bit
    (each level stands stably sorted by the bits above it)."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits = len(seq), bits
        self.words, self.before, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol[k] stands before place i[k]."""
        low = np.zeros_like(i)
        for level in range(self.bits):
            ones, low_ones = self._ones(level, i), self._ones(level, low)
            up = (symbol >> (self.bits - 1 - level)) & 1 == 1
            i = np.where(up, self.zeros[level] + ones, i - ones)
            low = np.where(up, self.zeros[level] + low_ones, low - low_ones)
        return i - low


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Places by the suffixes that start there (prefix doubling)."""
    n = len(seq)
    zero = seq == 0
    rank = np.where(zero, np.cumsum(zero) - 1, seq.astype(np.int64) + int(zero.sum()))
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        first = np.empty(n, np.int64)
        sorted_rank = rank[order]
        if k == 1:
            new = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
        else:
            pair = key[order]
            new = np.concatenate([[0], np.cumsum(pair[1:] != pair[:-1])])
        first[order] = new
        rank = first
        if n == 0 or new[-1] == n - 1:
            return order
        # behind the end of a run its separator decides, and that one is unique
        nxt = np.concatenate([rank[k:], np.full(min(k, n), -1, np.int64)])
        key = rank * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        k *= 2


class FMIndex:
    """seq: symbols from 1 in runs, a 0 before each run and one at the end."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 8):
        self.n = len(seq)
        order = suffix_order(seq)
        bwt = seq[order - 1]
        self.count = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))]).astype(np.int64)
        self.tree = WaveletTree(bwt.astype(np.int64), max(1, int(symbols - 1).bit_length()))
        self.bwt = bwt
        # the first place of each run is sampled, so that no walk meets a separator
        marked = (order % sample == 0) | (bwt == 0)
        self.marked = marked
        self.mark_rank = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of all patterns at once, by backward search;
        patterns: one a row, of symbols from 1, padded on the right."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > back) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - back].astype(np.int64)
            lo[live] = self.count[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.count[symbol] + self.tree.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows: steps back until a sampled one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            done = self.marked[at[open_]]
            hit = open_[done]
            out[hit] = self.samples[self.mark_rank[at[hit]]] + steps[hit]
            open_ = open_[~done]
            symbol = self.bwt[at[open_]].astype(np.int64)
            at[open_] = self.count[symbol] + self.tree.rank(symbol, at[open_])
            steps[open_] += 1
        return out

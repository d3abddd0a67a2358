"""An FM-index over words: suffix array, Burrows-Wheeler transform and a wavelet matrix, all as numpy arrays.

Searches and locations run over whole arrays of patterns at a time, so a shard is searched for thousands of
phrases without a loop over them.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``s`` in order, by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while n > 1:
        key = rank * (n + 1)
        key[: max(n - k, 0)] += rank[k:] + 1
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        k *= 2
    return np.arange(n)


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, high to low, the counts of ones before each position."""

    def __init__(self, s: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (s >> b) & 1
            before = np.zeros(len(s) + 1, np.int32)
            np.cumsum(one, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(s) - int(before[-1]))
            s = np.concatenate((s[one == 0], s[one == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        start = np.zeros_like(i)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = ones[start], ones[i]
            start, i = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, i - b)
        return i - start


class FMIndex:
    """Index of an array of symbols 1..top; a zero is put at its end."""

    def __init__(self, s: np.ndarray, top: int, every: int = 4):
        s = np.concatenate((s, [0])).astype(np.int64)
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.tree = Wavelet(self.bwt, top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=top + 1))))
        kept = sa % every == 0
        self.mark = np.concatenate(([0], np.cumsum(kept)))
        self.samples = sa[kept]
        self.kept = kept

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of the suffixes that begin with each row of ``patterns``, by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        for c in patterns.T[::-1]:
            low = self.first[c] + self.tree.rank(c, low)
            high = self.first[c] + self.tree.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every occurrence: steps back through the text to the next sampled position."""
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        at, steps, open_ = np.empty(len(i), np.int64), np.zeros(len(i), np.int64), np.arange(len(i))
        while len(open_):
            j = i[open_]
            done = self.kept[j]
            at[open_[done]] = self.samples[self.mark[j[done]]] + steps[open_[done]]
            open_, j = open_[~done], j[~done]
            c = self.bwt[j]
            i[open_] = self.first[c] + self.tree.rank(c, j)
            steps[open_] += 1
        return which, at

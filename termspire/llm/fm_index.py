"""An FM-index over a sequence of small integers, with batched searches."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in sort order; each 0 ends a run and sorts by its position.

    Prefix doubling: ranks by 1, 2, 4, … symbols, until all differ. No run is compared beyond its
    end, so the rounds are the logarithm of the longest run that repeats.
    """
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    width = 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        width *= 2


class WaveletTree:
    """Ranks in a sequence, by one level of bits for each bit of a symbol (as a matrix)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        row = symbols
        for level in range(self.levels):
            bit = ((row >> (self.levels - 1 - level)) & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(row) - bit.sum()))
            row = np.concatenate((row[~bit], row[bit]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        start = np.zeros(len(end), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - level)) & 1 == 1
            before, upto = ones[start], ones[end]
            start = np.where(bit, zeros + before, start - before)
            end = np.where(bit, zeros + upto, end - upto)
        return end - start

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        symbol = np.zeros(len(place), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[place]
            bit = ones[place + 1] - before == 1
            symbol = symbol * 2 + bit
            place = np.where(bit, zeros + before, place - before)
        return symbol


class FMIndex:
    """Searches in runs of symbols from 1 on, each run ended by a 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 8):
        order = suffix_order(symbols)
        previous = symbols[order - 1]  # before the first stands the last, a 0
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))
        self.tree = WaveletTree(previous, sigma)
        # Places that are multiples of the sample, and starts of runs, where a walk back must end.
        self.kept = (order % sample == 0) | (previous == 0)
        self.number = np.cumsum(self.kept) - 1
        self.places = order[self.kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of suffixes that start with each pattern (one row, one pattern)."""
        low = self.first[patterns[:, -1]].copy()
        high = self.first[patterns[:, -1] + 1].copy()
        for column in range(patterns.shape[1] - 2, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            symbol = patterns[live, column]
            start = self.first[symbol]
            low[live] = start + self.tree.rank(symbol, low[live])
            high[live] = start + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of rows start: walk back to a sampled place, and add the steps."""
        found = np.zeros(len(rows), np.int64)
        left, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.kept[rows]
            found[left[done]] = self.places[self.number[rows[done]]] + steps
            left, rows, steps = left[~done], rows[~done], steps + 1
            symbol = self.tree.at(rows)
            rows = self.first[symbol] + self.tree.rank(symbol, rows)
        return found

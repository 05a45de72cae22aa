"""A word-level FM-index: backward search by wavelet ranks, positions from a sampled suffix array."""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the compared length until all differ."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, np.diff(text[order]) != 0])
    width = 1
    while n and rank[order[-1]] < n - 1:
        later = np.zeros(n, np.int64)
        later[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
        width *= 2
    return order


class WaveletMatrix:
    """Ranks and symbols of a sequence of small integers, one row of bits per binary digit."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        rest = symbols
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1
            before = np.r_[0, np.cumsum(ones)].astype(np.int32)  # ones before each place
            zeros = len(rest) - int(before[-1])
            self.levels.append((bit, ones.astype(np.int8), before, zeros))
            rest = np.concatenate((rest[ones == 0], rest[ones == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start = np.zeros_like(end)
        for bit, _, before, zeros in self.levels:
            up = (symbol >> bit) & 1 == 1
            one_start, one_end = before[start], before[end]
            start = np.where(up, zeros + one_start, start - one_start)
            end = np.where(up, zeros + one_end, end - one_end)
        return end - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before that."""
        start, symbol = np.zeros_like(at), np.zeros_like(at)
        for bit, ones, before, zeros in self.levels:
            up = ones[at] == 1
            symbol = symbol | up.astype(np.int64) << bit
            start = np.where(up, zeros + before[start], start - before[start])
            at = np.where(up, zeros + before[at], at - before[at])
        return symbol, at - start


class FMIndex:
    """Index of a text of symbols 0 to size - 1. Patterns may not hold 0, which separates its parts."""

    def __init__(self, text: np.ndarray, size: int, every: int = SAMPLE_EVERY):
        text = np.r_[text, 0].astype(np.int64)
        # the smallest symbol of all closes the text, so that rows and suffixes correspond one to one
        shifted = text + 1
        shifted[-1] = 0
        suffixes = suffix_array(shifted)
        self.n = len(text)
        self.before = np.r_[0, np.cumsum(np.bincount(shifted, minlength=size + 1))].astype(np.int64)
        self.wavelet = WaveletMatrix(shifted[suffixes - 1], size + 1)
        sampled = suffixes % every == 0
        self.sampled, self.places = np.r_[0, np.cumsum(sampled)], suffixes[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows that begin with each pattern; patterns are rows aligned to the right."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1):
            step = alive[lengths[alive] >= back]
            if not len(step):
                break
            symbol = patterns[step, -back] + 1
            low[step] = self.before[symbol] + self.wavelet.rank(symbol, low[step])
            high[step] = self.before[symbol] + self.wavelet.rank(symbol, high[step])
            alive = step[low[step] < high[step]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row, by stepping back to a sampled one."""
        rows = rows.copy()
        found, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.sampled[at + 1] > self.sampled[at]
            done = open_[hit]
            found[done] = self.places[self.sampled[rows[done]]] + steps[done]
            open_ = open_[~hit]
            symbol, rank = self.wavelet.symbol_and_rank(rows[open_])
            rows[open_] = self.before[symbol] + rank
            steps[open_] += 1
        return found

"""FM-index of a sequence of small whole numbers, in numpy: suffix order, wavelet-tree ranks, backward search
of many phrases at once, and positions from a sample of the suffixes."""

from __future__ import annotations

import numpy as np

#: One suffix position in so many is kept.
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; the last symbol must be the only smallest one."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while True:
        key = rank * (n + 1)
        key[: n - reach] += rank[reach:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        reach = min(reach * 2, n)


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """``text`` holds numbers from 1 below ``symbols``; 0 is kept for the end."""
        text = np.append(text.astype(np.int64), 0)
        order = suffix_order(text)
        self.size = len(text)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels = []
        bits, row = max(1, int(symbols - 1).bit_length()), text[order - 1]
        for level in range(bits - 1, -1, -1):  # a wavelet tree whose levels lie end to end
            bit = row >> level & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            self.levels.append((level, ones, self.size - int(ones[-1])))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        kept = order % SAMPLE == 0
        self.marked = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        self.sample = order[kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each row of the transform."""
        start = np.zeros(len(at), np.int64)
        for level, ones, zeros in self.levels:
            up = symbol >> level & 1 == 1
            at = np.where(up, zeros + ones[at], at - ones[at])
            start = np.where(up, zeros + ones[start], start - ones[start])
        return at - start

    def before(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier."""
        at, start, symbol = row, np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for level, ones, zeros in self.levels:
            up = ones[at + 1] > ones[at]
            symbol |= up.astype(np.int64) << level
            at = np.where(up, zeros + ones[at], at - ones[at])
            start = np.where(up, zeros + ones[start], start - ones[start])
        return self.smaller[symbol] + at - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases are rows of symbols, filled up with -1 on the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            alive = alive[high[alive] > low[alive]]
            at = alive[phrases[alive, j] >= 0]
            c = phrases[at, j]
            low[at] = self.smaller[c] + self.rank(c, low[at])
            high[at] = self.smaller[c] + self.rank(c, high[at])
        return low, np.maximum(high, low)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence."""
        counts = high - low
        phrase = np.repeat(np.arange(len(low)), counts)
        row = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[phrase]
        position, steps, todo = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(todo):
            r = row[todo]
            found = self.marked[r + 1] > self.marked[r]
            position[todo[found]] = self.sample[self.marked[r[found]]] + steps
            todo = todo[~found]
            row[todo] = self.before(row[todo])
            steps += 1
        return phrase, position

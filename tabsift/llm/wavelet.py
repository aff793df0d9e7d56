"""A wavelet matrix over small symbols in numpy: rank queries for arrays of positions at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols below ``1 << bits`` in a sequence.

    One bit vector per level, the highest bit first; a level's zeros come before its ones in the next. Each vector keeps
    its words and the number of ones before each word, so a rank touches two numbers a level.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.bits, self.levels = len(symbols), bits, []
        for place in range(bits - 1, -1, -1):
            bit = (symbols >> place) & 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros((len(symbols) >> 6) + 1, dtype="<u8")
            words.view(np.uint8)[:len(packed)] = packed
            before = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            one = bit.astype(bool)
            self.levels.append((words, before, len(symbols) - int(np.count_nonzero(one))))
            if place:
                symbols = np.concatenate([symbols[~one], symbols[one]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before each position of ``at`` (0 to the size)."""
        first, last = np.zeros(1, dtype=np.int64), np.asarray(at, dtype=np.int64)
        for level, (words, before, zeros) in enumerate(self.levels):
            a, b = self._ones(words, before, first), self._ones(words, before, last)
            if (symbol >> (self.bits - 1 - level)) & 1:
                first, last = zeros + a, zeros + b
            else:
                first, last = first - a, last - b
        return last - first

    def count(self, symbols, at: np.ndarray) -> np.ndarray:
        """The ranks of several symbols together."""
        return sum((self.rank(s, at) for s in symbols), np.zeros(len(at), dtype=np.int64))

    def bisect(self, symbols, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The last position from ``low`` to ``high`` with at most ``wanted`` of ``symbols`` before it (counted from 0)."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.count(symbols, middle) <= wanted
            low, high = np.where(fits, middle, low), np.where(fits, high, np.maximum(middle - 1, low))
        return low

"""Elias-Fano coding of monotone sequences in numpy, and a two-level n-gram trie of such sequences.

A sequence of n values under u keeps the low ``l = log2(u / n)`` bits of each value packed, and the high parts as a unary
bit vector (a one for each value, a zero for each step of the high part): about 2 + l bits a value. Values are read by
selecting ones, the successor of x (the first value not under x) by selecting zeros and a search in one high part. The
arrays can be memory-mapped: a query touches a few words of them.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_ONE = np.uint64(1)


def _pack_low(values: np.ndarray, bits: int) -> np.ndarray:
    n = len(values)
    words = np.zeros((n * bits + 63) // 64 + 1, dtype=np.uint64)
    if bits and n:
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, values << shift)
        over = shift + np.uint64(bits) > 64
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


@dataclass
class EliasFano:
    n: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    zeros: np.ndarray  # zeros before each word of ``high``; rebuilt on opening

    @classmethod
    def build(cls, values: np.ndarray, last: int) -> EliasFano:
        """``values``: rising uint64, none over ``last``."""
        n = len(values)
        bits = max(0, ((last + 1) // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64)
        size = n + (last >> bits) + 1
        words = np.zeros((size + 63) // 64, dtype=np.uint64)
        place = high + np.arange(n)
        np.bitwise_or.at(words, place >> 6, _ONE << (place & 63).astype(np.uint64))
        mask = np.uint64((1 << bits) - 1)
        return cls.opened(n, bits, _pack_low(values & mask, bits), words)

    @classmethod
    def opened(cls, n: int, bits: int, low: np.ndarray, high: np.ndarray) -> EliasFano:
        ones = np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, low, high, np.concatenate([[0], np.cumsum(64 - ones)]))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        over = shift + np.uint64(self.bits) > 64
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & np.uint64((1 << self.bits) - 1)

    @staticmethod
    def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one in each word."""
        place, k = np.zeros(len(word), dtype=np.int64), k.copy()
        for step in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(word & np.uint64((1 << step) - 1)).astype(np.int64)
            up = k >= below
            k -= np.where(up, below, 0)
            word = np.where(up, word >> np.uint64(step), word)
            place += np.where(up, step, 0)
        return place

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        before = np.arange(len(self.zeros)) * 64 - self.zeros if ones else self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        word = np.minimum(word, len(self.high) - 1)
        held = self.high[word] if ones else ~self.high[word]
        return word * 64 + self._in_word(held, k - before[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not under x (n if there is none); x within the sequence's bounds."""
        high = (x >> np.uint64(self.bits)).astype(np.int64)
        rest = x & np.uint64((1 << self.bits) - 1)
        first = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        end = self._select(high, False) - high
        while (open_ := first < end).any():
            i = np.flatnonzero(open_)
            middle = (first[i] + end[i]) >> 1
            under = self._low(middle) < rest[i]
            first[i] = np.where(under, middle + 1, first[i])
            end[i] = np.where(under, end[i], middle)
        return first

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of x in a sequence of different values, or -1."""
        if not self.n:
            return np.full(len(x), -1, dtype=np.int64)
        at = self.successor(x)
        out = np.full(len(x), -1, dtype=np.int64)
        inside = np.flatnonzero(at < self.n)
        equal = self.access(at[inside]) == x[inside]
        out[inside[equal]] = at[inside[equal]]
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], dtype=np.uint64), self.low, self.high]


#: Quantisation of counts: exact to EXACT, then steps of a 2^(1/8).
EXACT = 32


def quantise(counts: np.ndarray) -> np.ndarray:
    """A byte for each positive count; 0 stands for none."""
    steps = np.rint(8 * np.log2(np.maximum(counts, 1) / EXACT)).astype(np.int64)
    return np.where(counts <= EXACT, counts, np.minimum(EXACT + steps, 255)).astype(np.uint8)


def restored(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.float64)
    return np.where(codes <= EXACT, codes, EXACT * np.exp2((codes - EXACT) / 8))


@dataclass
class Trie:
    """Words with exact counts, and for each word its successors with quantised joint counts.

    Level one: the words' 64-bit hashes in order, their running counts, and the pointers to their successors, all monotone.
    Level two: successors as 32-bit hashes relative to their context: rank of the context in the upper half, so that
    the whole level is one monotone sequence, searched from its context's range on.
    """

    words: EliasFano
    running: EliasFano
    pointers: EliasFano
    successors: EliasFano
    codes: np.ndarray

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, context: np.ndarray, successor: np.ndarray, joint: np.ndarray) -> Trie:
        """``words`` rising uint64 with their counts; (context rank, successor) rising with joint counts over 0."""
        starts = np.searchsorted(context, np.arange(len(words) + 1)).astype(np.uint64)
        running = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
        level = (context.astype(np.uint64) << np.uint64(32)) | successor.astype(np.uint64)
        return cls(EliasFano.build(words, (1 << 64) - 1), EliasFano.build(running, int(running[-1])),
                   EliasFano.build(starts, len(context)), EliasFano.build(level, max(len(words), 1) << 32), quantise(joint))

    def counts(self, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rank), dtype=np.int64)
        known = np.flatnonzero(rank >= 0)
        out[known] = (self.running.access(rank[known] + 1) - self.running.access(rank[known])).astype(np.int64)
        return out

    def joint(self, rank: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of (context rank, successor) pairs; 0 where the context or the pair is unknown."""
        out = np.zeros(len(rank), dtype=np.uint8)
        known = np.flatnonzero(rank >= 0)
        if len(known) and self.successors.n:
            r = rank[known]
            first, end = self.pointers.access(r).astype(np.int64), self.pointers.access(r + 1).astype(np.int64)
            some = first < end
            known, end = known[some], end[some]
            at = self.successors.find((rank[known].astype(np.uint64) << np.uint64(32)) | successor[known].astype(np.uint64))
            hit = (at >= 0) & (at < end)
            out[known[hit]] = self.codes[at[hit]]
        return out

    def to_file(self, path: str) -> None:
        parts = [p for s in (self.words, self.running, self.pointers, self.successors) for p in s.parts()]
        with open(path, "wb") as out:
            out.write(struct.pack("<13q", *(len(p) for p in parts), len(self.codes)))
            for p in parts:
                out.write(np.ascontiguousarray(p, dtype="<u8").tobytes())
            out.write(self.codes.tobytes())

    @classmethod
    def mapped(cls, path: str) -> Trie:
        """The trie over a memory-mapped file."""
        held = np.memmap(path, dtype=np.uint8, mode="r")
        sizes = struct.unpack("<13q", held[:104].tobytes())
        at, parts = 104, []
        for n in sizes[:12]:
            parts.append(held[at:at + 8 * n].view("<u8"))
            at += 8 * n
        levels = [EliasFano.opened(int(parts[i][0]), int(parts[i][1]), parts[i + 1], parts[i + 2]) for i in range(0, 12, 3)]
        return cls(*levels, held[at:at + sizes[12]])

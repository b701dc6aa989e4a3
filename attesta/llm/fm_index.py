"""An FM-index over one shard of word numbers: suffix order, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `s` in their order, by prefix doubling; only suffixes that aren't told apart yet are sorted again."""
    n, base = len(s), int(s.max()) + 2
    depth = 3 if base < 1 << 21 else 2
    key = s.astype(np.int64) + 1
    for d in range(1, depth):
        key *= base
        key[: n - d] += s[d:] + 1
    sa = np.argsort(key)
    key = key[sa]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        slots = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(slots):
            return sa
        at = sa[slots]
        after = at + depth
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)
        key, at = key[order], at[order]
        sa[slots] = at
        first[slots] = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(first[slots], slots, 0))
        depth *= 2


class Bits:
    """Rank over a bit vector: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """Wavelet tree over numbers, one bit vector a level, from the highest bit down."""

    def __init__(self, x: np.ndarray, size: int) -> None:
        self.width, self.levels = max(1, (size - 1).bit_length()), []
        # Where a symbol's places begin at the lowest level: its bits in reverse give the order there.
        symbols, reverse = np.arange(size), np.zeros(size, np.int64)
        for b in range(self.width):
            reverse = reverse << 1 | symbols >> b & 1
        order, count = np.argsort(reverse), np.bincount(x, minlength=size)
        self.start = np.empty(size, np.int64)
        self.start[order] = np.concatenate(([0], np.cumsum(count[order])[:-1]))
        for b in reversed(range(self.width)):
            one = (x >> b & 1).astype(bool)
            zeros = x[~one]
            self.levels.append((b, Bits(one), len(zeros)))
            x = np.concatenate((zeros, x[one]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before place i."""
        for b, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(symbol >> b & 1, zeros + ones, i - ones)
        return i - self.start[symbol]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and how often it stands before it."""
        symbol = np.zeros(len(i), np.int64)
        for b, bits, zeros in self.levels:
            one, ones = bits[i], bits.ones(i)
            symbol |= one.astype(np.int64) << b
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.start[symbol]


class FMIndex:
    """Index of a sequence of numbers below `size`; its last number occurs once. Every `step`-th position is sampled."""

    def __init__(self, s: np.ndarray, size: int, step: int = 16) -> None:
        sa = suffix_array(s)
        self.n = len(s)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=size))[:-1]))
        self.last = Wavelet(s[sa - 1], size)
        held = sa % step == 0
        self.held, self.positions = Bits(held), sa[held]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) row of each pattern, given as rows of numbers from the right; -1 fills up shorter ones on the left."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in patterns.T[::-1]:
            on = np.flatnonzero((column >= 0) & (low < high))
            symbol = column[on]
            low[on], high[on] = (self.smaller[symbol] + self.last.rank(symbol, x[on]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of some rows: steps back to a sampled one."""
        out, walked, open_, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(open_):
            held = self.held[at]
            out[open_[held]] = self.positions[self.held.ones(at[held])] + walked
            open_, at = open_[~held], at[~held]
            symbol, rank = self.last.symbol_and_rank(at)
            at, walked = self.smaller[symbol] + rank, walked + 1
        return out

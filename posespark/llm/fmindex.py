"""An FM-index over word numbers: wavelet matrix, ranks, sampled suffix positions.

Symbol 0 separates passages and is never searched. All steps work on whole NumPy
columns: every phrase is searched at once, every occurrence located at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE_RATE = 16


class BitRank:
    """A bit vector with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1]))

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Symbols by bit plane, from the highest bit; each plane sorted stably by the one above."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.planes: list[tuple[BitRank, int, int]] = []
        rest = symbols
        for level in range(bits - 1, -1, -1):
            on = (rest >> level) & 1 == 1
            self.planes.append((BitRank(on), level, int(len(rest) - on.sum())))
            rest = np.concatenate((rest[~on], rest[on]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at
        for plane, level, zeros in self.planes:
            on = (symbol >> level) & 1 == 1
            low1, high1 = plane.ones(low), plane.ones(high)
            low = np.where(on, zeros + low1, low - low1)
            high = np.where(on, zeros + high1, high - high1)
        return high - low

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        low, here, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for plane, level, zeros in self.planes:
            on = plane.get(here)
            symbol |= on.astype(np.int64) << level
            low1, here1 = plane.ones(low), plane.ones(here)
            low = np.where(on, zeros + low1, low - low1)
            here = np.where(on, zeros + here1, here - here1)
        return symbol, here - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; each separator counts as a symbol of its own, in order."""
    n = len(symbols)
    zero = symbols == 0
    separators = int(zero.sum())
    rank = np.where(zero, np.cumsum(zero) - 1, separators + symbols).astype(np.int64)
    width = 1
    while True:
        after = np.full(n, -1, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (int(after.max(initial=0)) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Index of one shard's symbols (0: separator; the last symbol must be one)."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, rate: int = SAMPLE_RATE):
        order = suffix_order(symbols)
        self.size = len(symbols)
        last_column = symbols[order - 1]  # before position 0 stands the last symbol, a separator
        self.wavelet = WaveletMatrix(last_column, max(1, int(n_symbols).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))))
        # every rate-th position and every passage start is kept, so no walk crosses a separator
        keep = (np.arange(self.size) % rate == 0) | (symbols[np.arange(self.size) - 1] == 0)
        kept = keep[order]
        self.kept = BitRank(kept)
        self.positions = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase.

        phrases: one a row, right-aligned. Searched from the last symbol to the first.
        """
        n, width = phrases.shape
        low, high = np.zeros(n, dtype=np.int64), np.full(n, self.size, dtype=np.int64)
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, width - 1 - step]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of each row's suffix: steps back to a kept position, plus the steps."""
        at, steps = rows.copy(), np.zeros_like(rows)
        walking = np.flatnonzero(~self.kept.get(at))
        while len(walking):
            symbol, before = self.wavelet.symbol_and_rank(at[walking])
            at[walking] = self.first[symbol] + before
            steps[walking] += 1
            walking = walking[~self.kept.get(at[walking])]
        return self.positions[self.kept.ones(at)] + steps


def occurrences(index: FMIndex, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, position) of every occurrence of every phrase."""
    low, high = index.search(phrases, lengths)
    counts = high - low
    which = np.repeat(np.arange(len(phrases)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return which, index.locate(low[which] + offset)

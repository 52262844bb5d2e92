"""A compressed full-text index over a text of small integers, for one shard.

The Burrows-Wheeler transform of the text is kept in a wavelet matrix of packed bits with a rank
directory. Patterns are matched by backward search, many at once: every step is a handful of numpy
operations over all patterns. Occurrences are located by walking back to sampled suffix positions.

Symbol 0 separates the pieces of the text. Separators compare by position, so no two suffixes are
equal and no match crosses a piece.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling."""
    n = len(text)
    ends = text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    span = 1
    while True:
        key = rank * np.int64(n + int(rank.max(initial=0)) + 2)
        key[: n - span] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        step = np.empty(n, np.int64)
        if n:
            step[0] = 0
            np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if not n or step[-1] == n - 1:
            return order
        span *= 2


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        """``text`` ends in a separator; its values lie below ``symbols``."""
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.size = n
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels: list[tuple[int, Bits, int]] = []
        rest = bwt
        for bit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            ones = (rest >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), n - int(ones.sum())))
            rest = np.concatenate([rest[~ones], rest[ones]])
        every = np.arange(symbols)
        self.first = self._walk(every, np.zeros(symbols, np.int64))
        # Sampled suffix positions; starts of pieces too, as no walk may cross a separator.
        taken = (order % sample == 0) | (bwt == 0)
        self.sampled = Bits(taken)
        self.positions = order[taken]

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each position."""
        return self._walk(symbol, at) - self.first[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of the patterns with a symbol put in front."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.before[symbol]
        return base + both[: len(low)], base + both[len(low) :]

    def search(self, patterns: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of equally long patterns (one a row).

        An interval that falls below ``least`` occurrences is given up and comes back empty.
        """
        count = len(patterns)
        low, high = np.zeros(count, np.int64), np.full(count, self.size, np.int64)
        live = np.arange(count)
        for column in reversed(range(patterns.shape[1])):
            low[live], high[live] = self.extend(patterns[live, column], low[live], high[live])
            few = high[live] - low[live] < least
            high[live[few]] = low[live[few]]
            live = live[~few]
        return low, high

    def symbol(self, row: np.ndarray) -> np.ndarray:
        """The transform's symbols in the given rows."""
        found, at = np.zeros(len(row), np.int64), row
        for bit, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            found |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ones, at - ones)
        return found

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in the given rows."""
        position = np.zeros(len(row), np.int64)
        live, at, steps = np.arange(len(row)), row.astype(np.int64), 0
        while len(live):
            done = self.sampled.get(at)
            position[live[done]] = self.positions[self.sampled.ones(at[done])] + steps
            live, at = live[~done], at[~done]
            symbol = self.symbol(at)
            at = self.before[symbol] + self.rank(symbol, at)
            steps += 1
        return position

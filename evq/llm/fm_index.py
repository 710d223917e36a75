"""FM-index of a sequence of small integers, built and queried with array operations.

Symbol 0 is a break: it ends every comparison of suffixes (breaks differ from
each other and sort by position), so no pattern can cross one. All queries take
arrays and answer many patterns at once.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions of the sequence keep their place in it.
SAMPLE = 32
#: Longest sequence of one index: three position-sized numbers must fit 63 bits.
LONGEST = (1 << 21) - 1


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the number of ones before each."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros((len(flags) // 64 + 1) * 64, np.uint8)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.ones = int(flags.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """Level-wise wavelet tree (matrix layout): one bit vector per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            flags = ((symbols >> level) & 1).astype(bool)
            self.levels.append(Bits(flags))
            self.zeros.append(len(symbols) - self.levels[-1].ones)
            symbols = np.concatenate([symbols[~flags], symbols[flags]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Position below the last level; minus that of position 0 it is the rank of the symbol."""
        for depth, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(at)
            one = (symbols >> (self.bits - 1 - depth)) & 1
            at = np.where(one == 1, zeros + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at positions, and the positions below the last level."""
        symbols = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(at)
            ones = bits.rank(at)
            symbols = (symbols << 1) | one
            at = np.where(one == 1, zeros + ones, at - ones)
        return symbols, at


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling over packed 64-bit keys."""
    n = len(text)
    place = n.bit_length()
    width = max(1, min(n, (63 - place) // bits))
    key = np.zeros(n, np.int64)
    open_ended = np.ones(n, dtype=bool)
    for step in range(width):
        symbol = np.zeros(n, np.int64)
        symbol[: n - step] = text[step:]
        symbol[~open_ended] = 0
        key = (key << bits) | symbol
        open_ended &= symbol != 0
    packed = (key << place) | np.arange(n)
    packed.sort()
    order = packed & ((1 << place) - 1)
    key = packed >> place
    head = np.ones(n + 1, dtype=bool)
    head[1:n] = (key[1:] != key[:-1]) | ~open_ended[order[1:]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    rows = np.flatnonzero(~(head[:-1] & head[1:]))
    while len(rows):
        suffix = order[rows]
        packed = (((rank[suffix] << place) | rank[suffix + width]) << place) | np.arange(len(rows))
        packed.sort()
        suffix = suffix[packed & ((1 << place) - 1)]
        key = packed >> place
        head = np.ones(len(rows) + 1, dtype=bool)
        head[1 : len(rows)] = key[1:] != key[:-1]
        order[rows] = suffix
        rank[suffix] = np.maximum.accumulate(np.where(head[:-1], rows, 0))
        rows = rows[~(head[:-1] & head[1:])]
        width *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """``text`` holds values below ``symbols``; its last value must be a break (0)."""
        if len(text) == 0 or text[-1] != 0:
            raise ValueError("the sequence must end with a break")
        if len(text) > LONGEST:
            raise ValueError("the sequence is too long for one index")
        text = text.astype(np.int64)
        bits = max(1, (symbols - 1).bit_length())
        order = suffix_array(text, bits)
        last = text[order - 1]  # of the first position: the final break
        self.size = len(text)
        self.tree = WaveletTree(last.astype(np.uint32), bits)
        counts = np.bincount(text, minlength=symbols + 1)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        every = np.arange(symbols, dtype=np.int64)
        self.base = self.tree.descend(every, np.zeros(symbols, np.int64))
        kept = (order % SAMPLE == 0) | (last == 0)
        self.kept = Bits(kept)
        self.places = order[kept].astype(np.int32)

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: per pattern (a row, padded at its end) the range of suffixes that start with it."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        for step in range(patterns.shape[1] if len(patterns) else 0):
            alive = np.flatnonzero((high > low) & (lengths > step))
            if not len(alive):
                break
            symbol = patterns[alive, lengths[alive] - 1 - step].astype(np.int64)
            both = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([low[alive], high[alive]]))
            shift = self.smaller[symbol] - self.base[symbol]
            low[alive] = shift + both[: len(alive)]
            high[alive] = shift + both[len(alive) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: step back through the text until a sampled one is met."""
        found = np.empty(len(rows), np.int64)
        pending, row, steps = np.arange(len(rows)), rows, 0
        while len(pending):
            known = self.kept.get(row) == 1
            found[pending[known]] = self.places[self.kept.rank(row[known])] + steps
            pending, row = pending[~known], row[~known]
            symbol, below = self.tree.access(row)
            row = self.smaller[symbol] + below - self.base[symbol]
            steps += 1
        return found

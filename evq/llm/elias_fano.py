"""Elias-Fano coding of non-decreasing integers, with select.

``n`` values below ``u`` take ``2 + log2(u / n)`` bits each: the low bits are
packed, the high bits are a unary bit vector. One 32-bit count of ones per 512
bits answers ``select`` without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

_SUPER = 512
_HEAD = struct.Struct("<qqqqq")


class EliasFano:
    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.before = n, base, low_bits, low, high, before

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        base = int(values[0]) if n else 0
        if (values[1:] < values[:-1]).any():
            raise ValueError("Elias-Fano needs values in ascending order")
        offset = values.astype(np.uint64) - np.uint64(base % (1 << 64))  # wraps: any range of 64-bit integers
        top = int(offset[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        if low_bits:
            bits = (offset[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        ones = (offset >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = (int(ones[-1]) // _SUPER + 1) * _SUPER if n else 0
        vector = np.zeros(size, np.uint8)
        vector[ones] = 1
        high = np.packbits(vector, bitorder="little")
        before = np.concatenate([[0], np.cumsum(vector.reshape(-1, _SUPER).sum(1, dtype=np.int64))])[:-1].astype(np.uint32)
        return cls(n, base, low_bits, low, high, before)

    def _low(self, index: np.ndarray) -> np.ndarray:
        result = np.zeros(len(index), np.uint64)
        for bit in range(self.low_bits):
            at = index * self.low_bits + bit
            result |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(bit)
        return result

    def _value(self, index: np.ndarray, ones: np.ndarray) -> np.ndarray:
        high = (ones - index).astype(np.uint64) << np.uint64(self.low_bits)
        return (high | self._low(index)).astype(np.int64) + self.base

    def select(self, index: int) -> int:
        """The value at a position, from one block of 512 bits."""
        if not 0 <= index < self.n:
            raise IndexError(index)
        block = int(np.searchsorted(self.before, index, side="right")) - 1
        bits = np.unpackbits(self.high[block * _SUPER // 8 : (block + 1) * _SUPER // 8], bitorder="little")
        one = block * _SUPER + int(np.flatnonzero(bits)[index - int(self.before[block])])
        return int(self._value(np.array([index]), np.array([one]))[0])

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return self._value(np.arange(self.n), ones)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.base, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.before.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The coded values, and the number of bytes read."""
        n, base, low_bits, n_low, n_high = _HEAD.unpack_from(data)
        at = _HEAD.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        blocks = n_high * 8 // _SUPER
        before = np.frombuffer(data, np.uint32, blocks, at + n_low + n_high)
        return cls(n, base, low_bits, low, high, before), at + n_low + n_high + 4 * blocks

"""Minimal perfect hash of 128-bit digests, as numpy arrays: n distinct digests get the slots 0 to n - 1.

Levels of bits: a digest that is alone in its place of a level gets the place's rank among all set bits; the others
go to the next level, hashed anew. A lookup is verified against the digest stored in the slot.
"""

from __future__ import annotations

import numpy as np

from evq.llm.words import join_hashes, mix

#: Places per digest that is left at a level.
ROOM = 2


class PerfectHash:
    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        """``high``, ``low``: the halves (uint64) of distinct digests."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, done = np.arange(len(high)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("digests are not distinct")
            size = max(64, ROOM * len(left))
            place = self._place(high[left], low[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((alone, done + np.cumsum(alone) - 1))
            done += int(alone.sum())
            left = left[~alone[place]]
        self.high, self.low = np.empty(len(high), np.uint64), np.empty(len(high), np.uint64)
        slots = self._slots(high, low)
        self.high[slots], self.low[slots] = high, low

    def __len__(self) -> int:
        return len(self.high)

    @staticmethod
    def _place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = mix(np.array([level + 1], np.uint64))
        return (join_hashes(high ^ seed, low) % np.uint64(size)).astype(np.int64)

    def _slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        slots, open_ = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(high[open_], low[open_], level, len(alone))
            hit = alone[place]
            slots[open_[hit]] = rank[place[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return slots

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for one that is not in the table."""
        slots = self._slots(high, low)
        found = slots >= 0
        found[found] = (self.high[slots[found]] == high[found]) & (self.low[slots[found]] == low[found])
        return np.where(found, slots, -1)

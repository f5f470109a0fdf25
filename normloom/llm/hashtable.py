"""A hash table in arrays, looked up for whole batches of keys at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Table:
    """Open-addressing map from pairs of 64-bit keys to small integers, in arrays."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.first, self.second = np.zeros(1 << bits, U64), np.zeros(1 << bits, U64)
        self.value = np.full(1 << bits, -1, np.int64)

    def _slot(self, first: np.ndarray) -> np.ndarray:
        return ((first * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where a key is missing."""
        out = np.full(len(first), -1, np.int64)
        open_, slot = np.arange(len(first)), self._slot(first)
        while len(open_):
            value = self.value[slot]
            same = (value >= 0) & (self.first[slot] == first[open_]) & (self.second[slot] == second[open_])
            out[open_[same]] = value[same]
            more = (value >= 0) & ~same
            open_, slot = open_[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, first: np.ndarray, second: np.ndarray, value: np.ndarray) -> None:
        """Add distinct keys that are not in the table."""
        self.size += len(first)
        slot = self._slot(first)
        while len(first):
            free = np.flatnonzero(self.value[slot] < 0)
            put = free[np.unique(slot[free], return_index=True)[1]]
            at = slot[put]
            self.first[at], self.second[at], self.value[at] = first[put], second[put], value[put]
            left = np.ones(len(first), bool)
            left[put] = False
            first, second, value, slot = first[left], second[left], value[left], (slot[left] + 1) & ((1 << self.bits) - 1)

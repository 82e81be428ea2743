"""A hash table of integers whose lookups and insertions work on whole arrays."""

from __future__ import annotations

import numpy as np


class IntTable:
    """Non-negative keys to non-negative values; open addressing, linear probing, at most half full."""

    def __init__(self, bits: int = 12):
        self.size = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits = bits
        self.key = np.full(1 << bits, -1, np.int64)
        self.value = np.full(1 << bits, -1, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def insert(self, key: np.ndarray, value: np.ndarray) -> None:
        """Keys must be distinct and new."""
        if 2 * (self.size + len(key)) > len(self.key):
            have = self.key >= 0
            key, value = np.concatenate([self.key[have], key]), np.concatenate([self.value[have], value])
            self._make(int(np.ceil(np.log2(len(key) + 1))) + 2)
            self.size = 0
        self.size += len(key)
        at, mask = self._slot(key), len(self.key) - 1
        while len(key):
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(at), bool)
            put[first] = True
            put &= self.key[at] < 0
            self.key[at[put]], self.value[at[put]] = key[put], value[put]
            key, value, at = key[~put], value[~put], (at[~put] + 1) & mask

    def get(self, key: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is negative or not there."""
        out = np.full(len(key), -1, np.int64)
        todo = np.flatnonzero(key >= 0)
        at, mask = self._slot(key[todo]), len(self.key) - 1
        while len(todo):
            found = self.key[at]
            hit = found == key[todo]
            out[todo[hit]] = self.value[at[hit]]
            more = ~hit & (found >= 0)
            todo, at = todo[more], (at[more] + 1) & mask
        return out

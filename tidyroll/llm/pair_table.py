"""Merges of token pairs in an open-addressing hash table of numpy arrays."""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
_EMPTY = np.int64(-1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank and result of each pair of ids; pairs that don't merge have the rank NONE."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(left)) - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, _EMPTY, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        self.results = np.zeros(size, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == _EMPTY]
            # of those that want one slot, the last written has it
            self.keys[slots[free]] = keys[free]
            mine = todo[self.keys[slots[todo]] == keys[todo]]
            self.ranks[slots[mine]] = rank[mine]
            self.results[slots[mine]] = result[mine]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, or an empty one; arrays of any shape."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 32) | right.astype(np.int64)).reshape(-1)
        slots = self._slot(keys)
        held = self.keys[slots]
        todo = np.flatnonzero((held != keys) & (held != _EMPTY))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slots[todo]]
            todo = todo[(held != keys[todo]) & (held != _EMPTY)]
        return slots.reshape(shape)

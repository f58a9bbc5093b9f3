"""Lookup of merge candidates by a pair of symbols, for whole arrays at once."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Maps (left, right) to (rank, made); open addressing at under a third full."""

    def __init__(self, left, right, rank, made) -> None:
        keys = np.asarray(left, np.int64) << 20 | np.asarray(right, np.int64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._rank, self._made = np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self._keys[slot[todo]] == -1
            self._keys[slot[todo[free]]] = keys[todo[free]]  # of two for one slot, the last stays
            stays = self._keys[slot[todo]] == keys[todo]
            at = todo[stays]
            self._rank[slot[at]], self._made[slot[at]] = np.asarray(rank)[at], np.asarray(made)[at]
            todo = todo[~stays]
            slot[todo] = (slot[todo] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self._shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` where there is no such pair) and merged symbol; negative symbols never match."""
        keys = np.where((left < 0) | (right < 0), -2, left << 20 | right)
        slot = self._slot(keys)
        there = self._keys[slot]
        todo = np.nonzero((there != keys) & (there != -1))[0]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self._mask
            there = self._keys[slot[todo]]
            todo = todo[(there != keys[todo]) & (there != -1)]
        return self._rank[slot], self._made[slot]

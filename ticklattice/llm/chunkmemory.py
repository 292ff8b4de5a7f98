"""What a worker remembers of chunks of text it has encoded: their ids, in arrays rather than in dictionaries.

Chunks are known by two independent 64-bit hashes of their bytes.  A whole Arrow batch is looked up at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import text as tx

#: Chunks of more bytes than this are encoded each time.
LONGEST = 64


class ChunkMemory:
    """An open-addressed table of hashes, and the ids of all chunks one after another."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self._table(1 << 14)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _table(self, slots: int) -> None:
        self.key, self.check = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.first, self.count = np.zeros(slots, np.int32), np.zeros(slots, np.uint16)
        self.held = 0

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot that holds each chunk, or -1."""
        mask = np.uint64(len(self.key) - 1)
        out, at, slot = np.full(len(key), -1, np.int64), np.arange(len(key)), (key & mask).astype(np.int64)
        while len(at):
            held = self.key[slot]
            hit = (held == key[at]) & (self.check[slot] == check[at])
            out[at[hit]] = slot[hit]
            on = ~hit & (held != 0)
            at, slot = at[on], (slot[on] + 1) & int(mask)
        return out

    def _put(self, key: np.ndarray, check: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Distinct chunks that the table lacks."""
        if 10 * (self.held + len(key)) > 7 * len(self.key):
            old = self.key != 0
            rest = self.key[old], self.check[old], self.first[old], self.count[old]
            self._table(1 << int(3 * (self.held + len(key)) // 2).bit_length())
            self._put(*rest)
        mask, at = len(self.key) - 1, np.arange(len(key))
        slot = (key & np.uint64(mask)).astype(np.int64)
        self.held += len(key)
        while len(at):
            free = self.key[slot] == 0
            # Of those that ask for one slot, the last gets it.
            self.first[slot[free]] = at[free]
            won = free.copy()
            won[free] = self.first[slot[free]] == at[free]
            s, a = slot[won], at[won]
            self.key[s], self.check[s], self.count[s] = key[a], check[a], count[a]
            self.first[s] = first[a]
            at, slot = at[~won], (slot[~won] + 1) & mask

    def _append(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def encode(self, raw: np.ndarray, first: np.ndarray, end: np.ndarray,
               learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks raw[first:end], one after another, and the number of each one's.

        ``learn`` gives both for distinct chunks that aren't remembered.
        """
        if self.held > self.most:
            self.clear()
        short = end - first <= LONGEST
        start, count = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        k = np.flatnonzero(short)
        key, check = (tx.word_hashes(raw, first[k], end[k], seed) for seed in (1, 2))
        key[key == 0] = 1
        slot = self._find(key, check)
        known = slot >= 0
        start[k[known]], count[k[known]] = self.first[slot[known]], self.count[slot[known]]
        new = np.flatnonzero(~known)
        fresh, inverse = self._distinct(key[new], check[new])
        long = np.flatnonzero(~short)
        data = raw.tobytes()
        at = np.concatenate([k[new[fresh]], long])
        if len(at):
            ids, size = learn([data[a:b] for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)])
            place = self._append(ids) + np.cumsum(size) - size
            m = len(fresh)
            self._put(key[new[fresh]], check[new[fresh]], place[:m], size[:m])
            start[k[new]], count[k[new]] = place[:m][inverse], size[:m][inverse]
            start[long], count[long] = place[m:], size[m:]
        total = np.cumsum(count)
        out = self.ids[np.repeat(start - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        if len(long):  # nobody asks for these again
            self.used -= int(count[long].sum())
        return out, count

    @staticmethod
    def _distinct(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, fresh, inverse = np.unique(key, return_index=True, return_inverse=True)
        if not (check[fresh][inverse] == check).all():  # two chunks share the first hash
            _, fresh, inverse = np.unique(np.stack([key, check]), axis=1, return_index=True, return_inverse=True)
        return fresh, inverse.ravel()

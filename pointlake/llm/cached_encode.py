"""Encoding of texts chunk by chunk, with the ids of every distinct chunk kept in the worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import textnum as tx


def same_bytes(one: np.ndarray, a: np.ndarray, two: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from each place ``a`` of ``one`` equal those from ``b`` of ``two``."""
    if not len(size):
        return np.zeros(0, bool)
    first = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(first, size)
    differs = np.r_[0, np.cumsum(one[np.repeat(a, size) + step] != two[np.repeat(b, size) + step])]
    return differs[first + size] == differs[first]


class ChunkEncoder:
    """``encode_new(list of byte strings) -> list of id lists`` is asked once for each distinct chunk.

    Chunks are found by 64-bit hashes, and their bytes are kept and compared, so that chunks of one hash
    never take each other's ids. At most ``most_kept`` chunks and ``most_bytes`` bytes of them are kept; then the worker
    starts anew, which changes the time but not the ids. Chunks of over ``long`` bytes are encoded each time.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], list], most_kept: int = 250_000, most_bytes: int = 8 << 20, long: int = 1024):
        self.encode_new, self.most_kept, self.most_bytes, self.long = encode_new, most_kept, most_bytes, long
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)  # of each key, the number of its chunk
        self.first = np.zeros(1, np.int64)  # of each chunk, its first id
        self.ids = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)  # of each chunk, its first byte
        self.bytes = np.zeros(0, np.uint8)

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        found = self.encode_new(texts)
        place = np.arange(len(self.first) - 1, len(self.first) - 1 + len(keys))
        self.first = np.r_[self.first, self.first[-1] + np.cumsum([len(x) for x in found])]
        self.ids = np.r_[self.ids, np.fromiter((i for x in found for i in x), np.int32)]
        self.begin = np.r_[self.begin, self.begin[-1] + np.cumsum([len(t) for t in texts])]
        self.bytes = np.r_[self.bytes, np.frombuffer(b"".join(texts), np.uint8)]
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, place)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """The number of the chunk of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.place[at], -1)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each chunk, all ids in order) for the byte ranges [start, end)."""
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        size = end - start
        keys, sample, which = np.unique(tx.hashes(data, start, end), return_index=True, return_inverse=True)
        short = size[sample] <= self.long
        new = short & (self._lookup(keys) < 0)
        if new.any():
            rows = sample[new]
            if len(self.keys) + len(rows) > self.most_kept or len(self.bytes) + size[rows].sum() > self.most_bytes:
                self._clear()
                new, rows = short, sample[short]  # all of this call must be known at once
            self._learn(keys[new], [data[a:b].tobytes() for a, b in zip(start[rows], end[rows], strict=True)])
        place = self._lookup(keys)[which]
        known = np.flatnonzero((place >= 0) & (size <= self.long))
        if len(known):
            chunk = place[known]
            ok = self.begin[chunk + 1] - self.begin[chunk] == size[known]
            known, chunk = known[ok], chunk[ok]
            known = known[same_bytes(data, start[known], self.bytes, self.begin[chunk], size[known])]
        count = np.zeros(len(start), np.int64)
        count[known] = self.first[place[known] + 1] - self.first[place[known]]
        others = np.setdiff1d(np.arange(len(start)), known, assume_unique=True)
        own = self.encode_new([data[start[i] : end[i]].tobytes() for i in others]) if len(others) else []
        count[others] = [len(x) for x in own]
        ends = np.cumsum(count)
        out = np.empty(ends[-1], np.int32)
        n = count[known]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(ends[known] - n, n) + step] = self.ids[np.repeat(self.first[place[known]], n) + step]
        for i, x in zip(others, own, strict=True):
            out[ends[i] - len(x) : ends[i]] = x
        return count, out

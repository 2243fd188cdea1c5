"""Vectorised words and hashes over UTF-8 buffers, and an exact open-addressing index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: ASCII white space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 21


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = np.asarray(x, np.uint64) + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A pseudo-random odd number for each byte value.
BYTE_VALUE = mix64(np.arange(256, dtype=np.uint64)) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """Words of a run of texts: 64-bit hash, byte span in ``data`` and text number of each."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray

    @property
    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, lower: bool = True) -> Words:
    """Split texts (``data`` at ``offsets``) at separator bytes, A-Z lower-cased; hash every word.

    Equal words have equal hashes in every process; different words differ but for a 64-bit collision.
    """
    data = LOWER[data] if lower else data
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] |= inside[edges]
    edges = edges[edges > 0] - 1
    last[edges] |= inside[edges]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, offsets, start, end, _hashes(data, start, end), doc)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    length = end - start
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max()), _BASE)]).astype(np.uint64))
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _PIECE, side="right")))
        n = length[at:to]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        value = BYTE_VALUE[data[np.repeat(start[at:to], n) + place]] * power[place]
        out[at:to] = np.add.reduceat(value, begin)
        at = to
    return mix64(out + length.astype(np.uint64))


def unique_counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their count, or the sum of their weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[new], np.diff(np.append(new, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(weights[order], new)


class HashIndex:
    """Position of 64-bit keys in a list of distinct keys, -1 if absent; exact."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, np.uint64)
        bits = max(4, int(2 * len(self.keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(self.keys), dtype=np.int32), self._slot(self.keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            placed = self.table[slot] == left
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _STEP) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(keys, np.uint64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        found = self.table[slot]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            got = self.table[slot]
            found[open_] = got
            on = (got >= 0) & (self.keys[got] != keys[open_])
            open_, slot = open_[on], slot[on]
        return found

"""Minimal perfect hash functions of 64-bit keys as mapped files: level bitmaps, ranks, the keys in hash order, and vectors of numbers in that order.

Keys are dealt over buckets of bounded size by their hash; each bucket is built by one task. On each level the keys still left hash
into a bitmap; a key alone in its place stays there, the others go on. A key's index is the rank of its bit, so n keys have the indexes 0 to n - 1, and
the key kept at that index tells members from strangers.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from spanframe.llm import arrays as A
from spanframe.llm.common import write_whole

#: Keys aimed at in a bucket; bits of a level for each key that reaches it; hash values that buckets are dealt from.
BUCKET_KEYS, WIDTH, SLOTS = 1 << 17, 1.5, 1 << 16
_STEP = 0x9E3779B97F4A7C15
MISSING = -1


def slot(keys: np.ndarray) -> np.ndarray:
    """A number under SLOTS for each key; buckets are equal ranges of it."""
    return (A.mix(keys.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(48)).astype(np.int64)


def bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return slot(keys) * buckets // SLOTS


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (A.mix(keys.astype(np.uint64) ^ np.uint64((level + 1) * _STEP % (1 << 64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of one bucket: their sizes in bits, all bitmaps as 64-bit words, set bits before each word, and the keys in order of their index."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray, keys: np.ndarray):
        self.sizes, self.words, self.ranks, self.keys = sizes, words, ranks, keys

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys."""
        rest, sizes, words = keys, [], []
        while len(rest):
            size = max(64, int(len(rest) * WIDTH) + 63 >> 6 << 6)
            at = _place(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = rest[~alone]
        all_words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ranks = np.cumsum(np.bitwise_count(all_words), dtype=np.int64) - np.bitwise_count(all_words)
        made = cls(np.array(sizes, np.int64), all_words, ranks, np.zeros(len(keys), np.int64))
        made.keys[made._index(keys)] = keys
        return made

    def _index(self, keys: np.ndarray) -> np.ndarray:
        out, rest, base = np.full(len(keys), MISSING, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(rest):
                break
            at = _place(keys[rest], level, size)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            own = self.words[word]
            hit = (own >> bit & np.uint64(1)).astype(bool)
            below = own[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[rest[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            rest, base = rest[~hit], base + (size >> 6)
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, MISSING for keys that were not there when it was built."""
        out = self._index(keys)
        own = np.flatnonzero(out >= 0)
        out[own[self.keys[out[own]] != keys[own]]] = MISSING
        return out


def save(folder: str, number: int, **arrays: np.ndarray) -> None:
    for name, values in arrays.items():
        write_whole(f"{folder}/{number}.{name}.npy", lambda out, values=values: np.save(out, values))


@lru_cache(4096)
def load(folder: str, number: int, name: str) -> np.ndarray | None:
    """A mapped array of a bucket; None where the bucket has no keys."""
    path = f"{folder}/{number}.{name}.npy"
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def opened(folder: str, number: int) -> PerfectHash | None:
    parts = [load(folder, number, name) for name in ("sizes", "words", "ranks", "keys")]
    return None if parts[0] is None else PerfectHash(*parts)


def look_up(folder: str, buckets: int, name: str, keys: np.ndarray) -> np.ndarray:
    """The numbers of vector ``name`` for keys, 0 for strangers."""
    out = np.zeros(len(keys), np.int64)
    at = bucket(keys, buckets)
    order = np.argsort(at, kind="stable")
    values, first = np.unique(at[order], return_index=True)
    for b, own in zip(values.tolist(), np.split(order, first[1:])):
        function = opened(folder, b)
        if function is not None:
            index = function.index(keys[own])
            known = index >= 0
            out[own[known]] = load(folder, b, name)[index[known]]
    return out

"""Numpy kernels over the bytes of a block of texts: words, lines, hashes, counts per document.

Texts stay UTF-8 bytes. A word is a run of bytes other than blank and 0x09-0x0D. Hashes have 64 bits and are mixed, so equal hashes
stand for equal words; n-gram buckets use tabulation hashing. All tables come from one fixed seed, so every task gets the same.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Powers kept between blocks.
KEPT_POWERS = 1 << 20
#: Bucket tables by place in a byte n-gram; n-grams of different n start with different rows.
_GRAM = _RNG.integers(0, 1 << 16, (8, 8, 256), dtype=np.uint16)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return tuple(np.multiply.accumulate(np.concatenate([one, np.full(n - 1, b, np.uint64)])) for b in (_BASE, _UNBASE))


_kept_powers = lru_cache(1)(_powers)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, n at least; one table for usual blocks is kept, larger ones are not."""
    return _kept_powers(KEPT_POWERS) if n <= KEPT_POWERS else _powers(n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_binary column without nulls."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return bytes_, ends - ends[0]


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every run of True that does not cross a document's end."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[ends] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, stops, np.searchsorted(ends, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums that ``span_hash`` turns into hashes of spans."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    back = powers(len(sums))[1]
    return mix((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))


def shingles(words: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of n words, and the index of its first word; windows stay in one document."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(docs[n - 1 :] == docs[: len(docs) - n + 1])
    h = words[at]
    for k in range(1, n):
        h = mix(h + np.uint64(_BASE)) + words[at + k]
    return mix(h), at


def per_doc(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, values, n)


def counts_in(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True values in each document's bytes."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[ends])


def again(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether it occurs more than once in its document, and whether it did before. Ordered input by document."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    own = mix(keys + docs.astype(np.uint64) * np.uint64(_BASE))
    order = np.argsort(own, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = own[order][1:] == own[order][:-1]
    often, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    often[order], before[order] = same[:-1] | same[1:], same[:-1]
    return often, before


def grams(data: np.ndarray, ends: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram of bytes at every place, and the places where it would leave its document."""
    if len(data) < n:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    m = len(data) - n + 1
    h = _GRAM[n, 0][data[:m]]
    for k in range(1, n):
        h = h ^ _GRAM[n, k][data[k : m + k]]
    out = np.unique((ends[1:, None] - np.arange(1, n)).ravel()) if n > 1 else np.zeros(0, np.int64)
    return h >> np.uint16(16 - bits), out[(out >= 0) & (out < m)]


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values (one per byte, or fewer at the end of the block) in each document; rows stay rows."""
    total = np.zeros((len(ends) - 1, *values.shape[1:]))
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        total[i] = values[a:b].sum(0, dtype=np.float64)
    return total

"""Token ids of whole texts through the tokenizers library, with a memory of words already encoded.

A text is cut only where the tokenizer itself cuts whatever stands around, so ids equal those of the whole text:

* byte-level BPE with its own pattern: a blank or line feed alone between characters that are not white space starts a new piece;
* BPE after a normaliser that makes white space one blank and a pattern that drops it: any blank or line feed.

ASCII marks after a letter are cut off likewise. Words are found, hashed (64 bits) and looked up as numpy arrays; only words not in the memory become
strings and go to the library. Texts with special-token strings, and texts for other tokenizers, are encoded whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from spanframe.llm import arrays as A

#: Words kept in a worker's memory, and bits of their hash table.
MOST_WORDS, TABLE_BITS = 700_000, 21
#: ASCII marks that stand apart from a letter before them; not the apostrophe, which some patterns keep with letters.
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
# White space beyond ASCII.
_WIDE_WHITE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: How a piece begins: after a blank that belongs to it, at the start of a text or after a mark, after a line feed.
BLANK, START, LINE = 0, 1, 2
_WAY = np.array([0, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B], np.uint64)


def _kind(spec: dict) -> str:
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return "whole"
    before, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
    if norm is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
        return "bytes"
    parts, steps = before.get("pretokenizers", []), (norm or {}).get("normalizers", [])
    drops = parts and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and "[^\\s" in parts[0]["pattern"].get("Regex", "")
    if drops and {"NFC", "Replace", "Lowercase"} == {s["type"] for s in steps} and all(s["pattern"] == {"Regex": "\\s+"} for s in steps if s["type"] == "Replace"):
        return "words"
    return "whole"


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes that belong to white space."""
    out = _WHITE[data]
    first = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    for c in _WIDE_WHITE:
        at = first[(data[first] == c[0]) & (first + len(c) <= len(data))]
        for k in range(1, len(c)):
            at = at[data[at + k] == c[k]]
        for k in range(len(c)):
            out[at + k] = True
    return out


class _Table:
    """Numbers by 64-bit key: open addressing in two arrays, looked up and filled for many keys at once."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that are not there."""
        out, slot, todo = np.full(len(keys), -1, np.int64), (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(todo):
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != 0)]
            slot[todo] = (slot[todo] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are new and different."""
        slot, todo = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            self.keys[slot[todo[free]]] = keys[todo[free]]
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask


class Encoder:
    """``encode(texts)`` gives one flat array of ids and the offsets of the texts in it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.kind = Tokenizer.from_file(path), _kind(spec)
        self.marks = [t["content"].encode() for t in spec["added_tokens"]]
        self.line = self._library(["\n"])[0]
        self._start()

    def _start(self) -> None:
        self.table, self.size, self.used = _Table(TABLE_BITS), 0, 0
        self.flat, self.key = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.uint64)
        self.starts, self.lengths, self.again = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their number, one after another, and where each ends."""
        n = self.lengths[at]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _keep(self, keys: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        n, m, total = self.size, len(keys), len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.starts):
            self.starts, self.lengths, self.again, self.key = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.again, self.key))
        self.flat[self.used : self.used + total] = flat
        self.starts[n : n + m], self.lengths[n : n + m], self.again[n : n + m], self.key[n : n + m] = self.used + np.cumsum(lengths) - lengths, lengths, False, keys
        self.table.add(keys, np.arange(n, n + m, dtype=np.int32))
        self.size, self.used = n + m, self.used + total

    def _forget(self) -> None:
        """Keep only the words met again since the last time."""
        at = np.flatnonzero(self.again[: self.size])
        keys, flat, lengths = self.key[at], self._gather(at)[0], self.lengths[at]
        self._start()
        if 2 * len(keys) < MOST_WORDS:
            self._keep(keys, flat, lengths)

    def _spell(self, data: bytes, start: int, stop: int, way: int) -> str:
        word = data[start:stop].decode()
        return " " + word if self.kind == "bytes" and way == BLANK else word

    def _learn(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, ways: np.ndarray, hashes, ends: np.ndarray) -> None:
        """Add words, given by their spans; those with marks after a letter, or after a line feed, as the ids of their parts."""
        head = np.maximum(np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[stops - 1] + 1, starts)
        last = data[np.maximum(head - 1, 0)]
        two = data[np.maximum(head - 2, 0)]
        letter = _ALPHA[last] | ((two == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (head - 2 >= starts))
        split = (head > starts) & (head < stops) & letter
        body_stop = np.where(split, head, stops)
        body_way = np.where(ways == LINE, START, ways)
        body, tail = hashes(starts, body_stop, body_way), hashes(body_stop, stops, np.full(len(stops), START))
        leaves = [np.concatenate([x, y[split]]) for x, y in ((body, tail), (starts, body_stop), (body_stop, stops), (body_way, np.full(len(starts), START)))]
        new, first = np.unique(leaves[0], return_index=True)
        missing = self.table.find(new) < 0
        new, first = new[missing], first[missing]
        text = data.tobytes()
        for i in range(0, len(new), 4000):
            own = first[i : i + 4000]
            ids = self._library([self._spell(text, *span) for span in zip(*(x[own].tolist() for x in leaves[1:]))])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._keep(new[i : i + 4000], np.fromiter((x for one in ids for x in one), np.uint32, int(lengths.sum())), lengths)
        whole = hashes(starts, stops, ways)
        made = np.flatnonzero((split | (ways == LINE)) & (self.table.find(whole) < 0))
        if len(made):
            one, end_one = self._gather(self.table.find(body[made]))
            rest = made[split[made]]
            two_, end_two = self._gather(self.table.find(tail[rest]))
            ids, sizes = [], []
            tails = dict(zip(rest.tolist(), np.split(two_, end_two[:-1]))) if len(rest) else {}
            for i, ids_one in zip(made.tolist(), np.split(one, end_one[:-1])):
                parts = [*([self.line] if ways[i] == LINE else []), ids_one, *([tails[i]] if i in tails else [])]
                ids += parts
                sizes.append(sum(map(len, parts)))
            self._keep(whole[made], np.concatenate([np.asarray(x, np.uint32) for x in ids]), np.array(sizes, np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of UTF-8 texts as large_binary without nulls; takes a block at a time."""
        data, ends = A.raw(texts)
        n, whole = len(ends) - 1, np.zeros(len(ends) - 1, bool)
        raw = data.tobytes()
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0:
                whole[np.searchsorted(ends, at, "right") - 1] = True
                at = raw.find(mark, at + 1)
        if self.kind == "whole":
            whole[:] = True
        if self.size > MOST_WORDS:
            self._forget()
        gap = _BREAK[data]
        if self.kind == "bytes" and len(data):
            white = _white(data)
            alone = gap.copy()
            alone[1:] &= ~white[:-1]
            alone[:-1] &= ~white[1:]
            edges = np.concatenate([ends[:-1], ends[1:] - 1])
            alone[edges[(edges >= 0) & (edges < len(data))]] = False
            gap = alone
        starts, stops, docs = A.runs(~gap, ends)
        keep = ~whole[docs]
        starts, stops, docs = starts[keep], stops[keep], docs[keep]
        sums = A.prefix_hash(data)
        low = high = None
        if self.kind == "words":
            low, high = A.prefix_hash(A.LOWER[data]), np.concatenate([[0], np.cumsum(data >= 0x80)])

        def hashes(a: np.ndarray, b: np.ndarray, way: np.ndarray) -> np.ndarray:
            h = A.span_hash(sums, a, b)
            if low is not None:
                return np.maximum(np.where(high[b] > high[a], h, A.span_hash(low, a, b)), np.uint64(1))
            return np.maximum(h ^ _WAY[way], np.uint64(1))

        ways = np.zeros(len(starts), np.int64)
        if self.kind == "bytes":
            at_start = starts == ends[docs]
            ways[at_start] = START
            ways[~at_start & (data[np.maximum(starts - 1, 0)] == 0x0A)] = LINE
        keys = hashes(starts, stops, ways)
        at, known = self.table.find(keys), self.size
        if len(new := np.flatnonzero(at < 0)):
            some = new[np.unique(keys[new], return_index=True)[1]]
            self._learn(data, starts[some], stops[some], ways[some], hashes, ends)
            at[new] = self.table.find(keys[new])
        self.again[at[at < known]] = True
        flat, stops_ = self._gather(at)
        edges = np.concatenate([[0], stops_])[np.searchsorted(docs, np.arange(n + 1))]
        if whole.any():
            rows, lengths = np.split(flat, edges[1:-1]), np.diff(edges)
            own = np.flatnonzero(whole)
            for i, ids in zip(own, self._library([raw[ends[i] : ends[i + 1]].decode() for i in own])):
                rows[i], lengths[i] = np.asarray(ids, np.uint32), len(ids)
            flat, edges = np.concatenate(rows), np.concatenate([[0], np.cumsum(lengths)])
        return flat, edges


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)

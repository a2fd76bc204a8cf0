"""Hashed n-gram logistic regression: features of whole texts, training in shards, scoring of blocks.

A family is a kind of n-gram with its own table of 2**BITS buckets; a feature is the share of a text's n-grams of that family. Weights
are therefore summed over a text's n-grams and divided by their number, without a table of counts for each text.
Training rows are dealt to a fixed number of tasks; each fits its rows, and the driver averages the (bounded) weight tables.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm import arrays as A
from spanframe.llm.common import text_blocks

BITS = 15
SHARDS = 6
Buckets = list[tuple[np.ndarray, np.ndarray]]


def _places(docs: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(docs, np.arange(n + 1))


def families(data: np.ndarray, ends: np.ndarray, words: tuple[int, ...], chars: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family: bucket of every n-gram, where each text's begin in that list, and list places to leave out."""
    out, data = [], A.LOWER[data]
    if words:
        starts, stops, docs = A.runs(~A.SPACE[data], ends)
        one = A.span_hash(A.prefix_hash(data), starts, stops)
        for n in words:
            h, at = (one, np.arange(len(one))) if n == 1 else A.shingles(one, docs, n)
            out.append(((h >> np.uint64(64 - BITS)).astype(np.int32), _places(docs[at], len(ends) - 1), np.zeros(0, np.int64)))
    for n in chars:
        h, bad = A.grams(data, ends, n, BITS)
        out.append((h, np.minimum(ends, len(h)), bad))
    return out


def _total(places: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.maximum(np.diff(places) - np.diff(np.searchsorted(bad, places)), 1)


@dataclass
class Linear:
    words: tuple[int, ...]
    chars: tuple[int, ...]
    weights: np.ndarray  # families x 2**BITS x outputs, float32
    bias: np.ndarray

    def margins(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """texts x outputs."""
        z = np.tile(self.bias.astype(np.float64), (len(ends) - 1, 1))
        for table, (buckets, places, bad) in zip(self.weights, families(data, ends, self.words, self.chars)):
            values = np.concatenate([table[buckets], np.zeros((1, table.shape[1]), np.float32)])
            values[bad] = 0
            sums = np.add.reduceat(values, places[:-1], axis=0)
            sums[places[1:] == places[:-1]] = 0
            z += sums / _total(places, bad)[:, None]
        return z


def rows_of(data: np.ndarray, ends: np.ndarray, words: tuple[int, ...], chars: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse features of each text: (index, share)."""
    out: list[list] = [[] for _ in range(len(ends) - 1)]
    for f, (buckets, places, bad) in enumerate(families(data, ends, words, chars)):
        good = np.ones(len(buckets), bool)
        good[bad] = False
        for i, (a, b) in enumerate(zip(places, places[1:])):
            own = np.bincount(buckets[a:b][good[a:b]])
            at = np.flatnonzero(own)
            out[i].append((at + (f << BITS), own[at] / max(1, own.sum())))
    return [(np.concatenate([a for a, _ in r]).astype(np.int32), np.concatenate([v for _, v in r]).astype(np.float32)) for r in out]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, weights: np.ndarray, n_families: int, epochs: int = 12, batch: int = 32, rate: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """AdaGrad on the logistic loss, each output by itself; targets are 0 or 1 (texts x outputs)."""
    size, k = n_families << BITS, targets.shape[1]
    w, squares, bias = np.zeros((k, size), np.float32), np.full((k, size), 1e-6, np.float32), np.zeros(k)
    rng = np.random.default_rng(7)
    weights = weights / weights.mean() if len(weights) else weights
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            index = np.concatenate([rows[j][0] for j in own])
            value = np.concatenate([rows[j][1] for j in own])
            where = np.repeat(np.arange(len(own)), [len(rows[j][0]) for j in own])
            touched, at = np.unique(index, return_inverse=True)
            for b in range(k):
                z = np.bincount(where, w[b, index] * value, len(own)) + bias[b]
                g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - targets[own, b]) * weights[own] / len(own)
                grad = np.bincount(at, value * g[where], len(touched)).astype(np.float32)
                squares[b, touched] += grad * grad
                w[b, touched] -= rate * grad / np.sqrt(squares[b, touched])
                bias[b] -= 0.3 / (1 + epoch) * g.sum()
    return w.reshape(k, n_families, 1 << BITS).transpose(1, 2, 0), bias


def train(sample: DataFrame, outputs: Callable[[np.ndarray], np.ndarray], words: tuple[int, ...], chars: tuple[int, ...], epochs: int = 12) -> Linear | None:
    """Fit on a bounded table (doc_id, text, label, weight), dealt to SHARDS tasks; None if it is empty. ``outputs`` turns labels into 0/1 targets."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, weights = [], [], []
        for block in text_blocks(batches):
            rows += rows_of(*A.raw(block.column("text")), words, chars)
            labels.append(block.column("label").to_numpy(zero_copy_only=False))
            weights.append(block.column("weight").to_numpy())
        if rows:
            w, bias = fit(rows, outputs(np.concatenate(labels)), np.concatenate(weights), len(words) + len(chars), epochs)
            out = io.BytesIO()
            np.savez_compressed(out, w=w.astype(np.float32), bias=bias, n=len(rows))
            yield pa.RecordBatch.from_pydict({"model": [out.getvalue()]})

    dealt = sample.repartition(SHARDS, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS))).sortWithinPartitions("doc_id")
    models = [np.load(io.BytesIO(r[0])) for r in dealt.select("text", "label", "weight").mapInArrow(shard, "model binary").collect()]
    if not models:
        return None
    share = np.array([int(m["n"]) for m in models], float)
    share /= share.sum()
    return Linear(words, chars, sum(s * m["w"] for s, m in zip(share, models)).astype(np.float32), sum(s * m["bias"] for s, m in zip(share, models)))


def apply_blocks(df: DataFrame, text: str, keep: tuple[str, ...], fn: Callable[[pa.Array, np.ndarray, np.ndarray], dict[str, np.ndarray | pa.Array]], schema: str) -> DataFrame:
    """The kept columns and those that ``fn`` makes of each block of texts (the column, its bytes, their offsets)."""
    fields = [df.schema[n] for n in keep]
    read = [*keep, *([] if text in keep else [text])]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, batch.column(read.index(text))
            for block in text_blocks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
                made = fn(texts.slice(at, block.num_rows), *A.raw(block.column("text")))
                kept = [batch.column(i).slice(at, block.num_rows) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v) for v in made.values())], names=[*keep, *made])
                at += block.num_rows

    return df.select(*read).mapInArrow(rows, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + schema)

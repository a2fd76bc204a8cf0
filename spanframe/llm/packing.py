"""Operator 8: packing documents into sequences of a fixed number of tokens by exact-complement hashing, then best fit.

Only the *lengths* decide where pieces go, and there are at most ``capacity`` different ones. Spark counts the pieces of each
length; the plan is made on that histogram, whose size does not depend on the data: repeatedly the longest available length
opens a sequence, an index of single, pair and triple length sums gives the combination that fills the gap exactly, and as many
sequences of this pattern are made at once as the counts allow. Where no combination fits exactly, the longest length that fits
(best fit) goes in and the search goes on with the smaller gap. Pieces then take the places of their length in order of
their rank, and ranks come from counts per (partition, length) and their prefix sums, so no task sees all pieces of a length.

Defined results: a null text is an empty document (the end id alone); rows with a repeated or null doc_id are packed as documents of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import stored, text_blocks
from spanframe.llm.tokens import encoder


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole pieces of ``capacity``, a shorter one first if they don't come out even."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank[, ids]): part is the task, rank counts its pieces of the same length."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for block in text_blocks(batches):
            flat, offsets = encode.encode(block.column("text"))
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * with_ids)}
            for doc, a, b in zip(block.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = (doc, k, start, length, zlib.crc32(own.tobytes()), part, seen[length], *[own.astype(np.int32)] * with_ids)
                    for column, value in zip(out.values(), row):
                        column.append(value)
                    seen[length] += 1
            types = {"piece": pa.int32(), "part": pa.int32(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)


class _Sums:
    """Which available lengths, alone or as a pair or triple, add up to a sum."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.tolist()
        lengths = [x for x in range(len(counts) - 1, 0, -1) if counts[x]]
        self.lengths = lengths
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for i, a in enumerate(lengths):
            for b in lengths[i:]:
                if a + b < len(counts):
                    self.pairs.setdefault(a + b, []).append((a, b))

    def has(self, need: tuple[int, ...], used: Counter) -> bool:
        return all(self.left[x] - used[x] >= need.count(x) for x in need)

    def pair(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        own = self.pairs.get(gap, [])
        while own and not (self.left[own[0][0]] and self.left[own[0][1]]):
            own.pop(0)
        return next((p for p in own if self.has(p, used)), None)

    def exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        if self.has((gap,), used):
            return (gap,)
        if found := self.pair(gap, used):
            return found
        for c in self.lengths:
            if c < gap and self.has((c,), used):
                for p in self.pairs.get(gap - c, ()):
                    if self.has((c, *p), used):
                        return (c, *p)
        return None

    def longest(self, gap: int, used: Counter) -> int:
        return next((x for x in self.lengths if x <= gap and self.left[x] > used[x]), 0)


def fill(counts: np.ndarray) -> list[tuple[int, Counter]]:
    """(copies, lengths of one sequence) for a histogram of lengths whose last index is the capacity; uses every count up."""
    sums, capacity, plan = _Sums(counts), len(counts) - 1, []
    while first := sums.longest(capacity, Counter()):
        used, gap = Counter([first]), capacity - first
        while gap:
            if found := sums.exact(gap, used):
                used.update(found)
                break
            if not (best := sums.longest(gap, used)):
                break
            used[best] += 1
            gap -= best
        copies = min(sums.left[x] // n for x, n in used.items())
        for x, n in used.items():
            sums.left[x] -= copies * n
        sums.lengths = [x for x in sums.lengths if sums.left[x]]
        plan.append((copies, used))
    return plan


def places(counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each run of places, its first sequence, its offset there."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken, sequence = Counter(), 0
    for copies, used in fill(counts):
        offset = 0
        for length in sorted(used, reverse=True):
            for _ in range(used[length]):
                out.setdefault(length, []).append((taken[length], sequence, offset))
                taken[length] += copies
                offset += length
        sequence += copies
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in out.items()}


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """Give every piece of a stored table with (length, part, rank) its sequence_id and offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    plan = places(counts)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = items.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = np.zeros_like(at), np.zeros_like(at)
            for x in np.unique(length):
                own = length == x
                ranks, sequences, offsets = plan[int(x)]
                run = np.searchsorted(ranks, at[own], "right") - 1
                sequence[own], offset[own] = sequences[run] + at[own] - ranks[run], offsets[run]
            keep = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in ("part", "rank", "base")]
            yield pa.RecordBatch.from_pydict(dict(keep) | {"sequence_id": sequence, "offset": offset})

    kept = [f for f in items.schema.fields if f.name not in ("part", "rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return items.join(bases, ["length", "part"]).select(*items.columns, "base").mapInArrow(place, schema)


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece."""
    return pack(stored(pieces(documents, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the token sequences of a packing made with ids; a group has at most ``capacity`` tokens."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select(
        "sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"), F.col("rows.length").alias("lengths")
    )

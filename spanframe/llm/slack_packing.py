"""Operator 12: packing documents into sequences of a fixed number of tokens by minimum bin slack.

A document longer than the capacity gives whole sequences and a shorter first piece; what is left to place is a histogram of lengths, whose size the
capacity bounds, whatever the size of the data. For each sequence the longest remaining length opens the window, and a subset-sum dynamic program over a bitset (bit s is set
if some multiset of remaining lengths adds up to s; counts enter as binary multiples) finds the sum closest to the capacity; going back through the
bitsets gives the counts of the lengths in it. As many sequences of that pattern are made at once as the counts allow. Slack that no multiset of
the remaining lengths can fill goes to a cut: a remaining length gives the missing tokens and its rest joins the lengths again. When fewer tokens than the
capacity are left, the window is the largest power of two that they fill, where a sequence needs no padding. So no sequence has padding, and few documents are cut.

Pieces take the places of their length in order of their rank; ranks come from counts per (partition, length) and their prefix sums, so no task sees
all pieces of a length. Only lengths move through shuffles; ids are read again for the few lengths with cut pieces, whose checksums need them.

Defined results: a null text is an empty document (the end id alone); rows with a repeated or null doc_id are packed as documents of
their own; documents of equal length share out their places by partition and order there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import stored, text_blocks
from spanframe.llm.tokens import encoder

_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def id_type(tokenizer: str, end_id: int) -> str:
    """Numpy type that holds all ids of a tokenizer."""
    return "<u2" if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def heads_and_wholes(documents: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, rank, ids): a shorter first piece and whole pieces of each document.

    part is the task, rank counts its pieces of the same length; ids are packed, and null for whole pieces, which are never cut again.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind, part, seen = encoder(tokenizer), id_type(tokenizer, end_id), TaskContext.get().partitionId(), Counter()
        for block in text_blocks(batches):
            flat, offsets = encode.encode(block.column("text"))
            out: list[tuple] = []
            for doc, a, b in zip(block.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                n = len(ids)
                first = n % capacity or capacity
                for start, stop in zip((0, *range(first, n, capacity)), (*range(first, n, capacity), n)):
                    length, own = stop - start, ids[start:stop]
                    out.append((doc, start, length, zlib.crc32(own), n, part, seen[length], None if length == capacity else own.astype(kind).tobytes()))
                    seen[length] += 1
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids")
            columns = list(zip(*out)) if out else [()] * len(names)
            types = {"part": pa.int32(), "ids": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.int64())) for k, v in zip(names, columns)})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long, ids binary"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)


def closest(lengths: list[int], left: dict[int, int], used: Counter, gap: int) -> Counter:
    """The multiset of remaining lengths whose sum is closest to ``gap`` from below. ``lengths`` are in descending order."""
    bits, full, history = 1, (1 << (gap + 1)) - 1, []
    for x in lengths:
        if x > gap:
            continue
        count, many = min(left[x] - used[x], gap // x), 1
        while count > 0:
            take = min(many, count)
            history.append((bits, x, take))
            bits |= (bits << (x * take)) & full
            count, many = count - take, many * 2
        if bits >> gap & 1:
            break
    target, found = bits.bit_length() - 1, Counter()
    for before, x, take in reversed(history):
        if not before >> target & 1:
            found[x] += take
            target -= x * take
    return found


class Planner:
    """Places for a histogram of lengths. A run is (length of the piece, first rank, count, first sequence, offset, start in the piece, tokens)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequence, self.runs = capacity, 0, []
        self.stock: dict[int, deque] = {x: deque([(x, 0, 0, n)]) for x, n in counts.items() if n}  # (piece's length, start in it, first rank, count)
        self.left = {x: n for x, n in counts.items() if n}
        self.lengths = sorted(self.left, reverse=True)
        self.total = sum(x * n for x, n in self.left.items())

    def _take(self, length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        self.left[length] -= n
        queue = self.stock[length]
        while n:
            piece, start, rank, count = queue.popleft()
            if count > n:
                queue.appendleft((piece, start, rank + n, count - n))
                count = n
            n -= count
            yield piece, start, rank, count
        if not self.left[length]:
            del self.left[length], self.stock[length]
            self.lengths.remove(length)

    def _put(self, length: int, piece: int, start: int, rank: int, count: int) -> None:
        if length not in self.left:
            self.left[length], self.stock[length] = 0, deque()
            at = next((i for i, x in enumerate(self.lengths) if x < length), len(self.lengths))
            self.lengths.insert(at, length)
        self.left[length] += count
        self.stock[length].append((piece, start, rank, count))

    def _place(self, length: int, copies: int, offset: int, tokens: int) -> None:
        """The next ``copies`` pieces of a length, or their first ``tokens``, one in each sequence."""
        at, rests = self.sequence, []
        for piece, start, rank, count in self._take(length, copies):
            self.runs.append((piece, rank, count, at, offset, start, tokens))
            rests.append((piece, start + tokens, rank, count))
            at += count
        if tokens < length:
            for rest in rests:
                self._put(length - tokens, *rest)

    def step(self) -> None:
        """Places one pattern of lengths as often as the counts allow."""
        window = self.capacity if self.total >= self.capacity else 1 << (self.total.bit_length() - 1)
        head = next((x for x in self.lengths if x <= window), 0)
        used = Counter([head] if head else [])
        used.update(closest(self.lengths, self.left, used, window - head))
        slack = window - sum(x * n for x, n in used.items())
        needs, cut = Counter(used), 0
        if slack:  # every length not used up is larger than the slack, else the sum was not the closest
            cut = next(x for x in self.lengths if self.left[x] > used[x])
            needs[cut] += 1
        copies = min(self.left[x] // n for x, n in needs.items())
        offset = 0
        for x in sorted(used, reverse=True):
            for _ in range(used[x]):
                self._place(x, copies, offset, x)
                offset += x
        if slack:
            self._place(cut, copies, offset, slack)
        self.sequence += copies
        self.total -= copies * window

    def plan(self) -> list[tuple[int, int, int, int, int, int, int]]:
        while self.total:
            self.step()
        return self.runs


class Places:
    """Runs by length of the piece: those of whole pieces, sorted by rank, and those of cut ones."""

    def __init__(self, runs: list[tuple[int, int, int, int, int, int, int]]):
        table = np.array(runs, np.int64).reshape(-1, 7)
        table = table[np.lexsort((table[:, 5], table[:, 1], table[:, 0]))]
        whole = table[:, 6] == table[:, 0]
        self.whole, self.cut = self._by_length(table[whole]), self._by_length(table[~whole])

    @staticmethod
    def _by_length(table: np.ndarray) -> dict[int, np.ndarray]:
        values, first = np.unique(table[:, 0], return_index=True)
        return dict(zip(values.tolist(), np.split(table[:, 1:], first[1:])))

    def of_whole(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, sequence, offset) of those ranks whose piece stays whole."""
        runs = self.whole.get(length, np.zeros((0, 6), np.int64))
        at = np.searchsorted(runs[:, 0], ranks, "right") - 1
        ok = np.flatnonzero((at >= 0) & (ranks < runs[np.maximum(at, 0), 0] + runs[np.maximum(at, 0), 1]) if len(runs) else np.zeros(len(ranks), bool))
        own = runs[at[ok]]
        return ok, own[:, 2] + ranks[ok] - own[:, 0], own[:, 3]


def pack(items: DataFrame, capacity: int, kind: str) -> DataFrame:
    """Places of a stored table of pieces; ``kind`` is the type of their packed ids."""
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = Places(Planner(counts, capacity).plan())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = items.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))

    def place_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            keep, sequence, offset = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, rows in zip(values.tolist(), np.split(order, first[1:])):
                ok, s, o = places.of_whole(x, at[rows])
                keep.append(rows[ok])
                sequence.append(s)
                offset.append(o)
            own = batch.take(pa.array(np.concatenate(keep)))
            columns = {n: own.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": np.concatenate(sequence), "offset": np.concatenate(offset)})

    def place_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                runs, at = places.cut[row["length"]], row["rank"] + row["base"]
                for rank, _, sequence, offset, start, tokens in runs[(runs[:, 0] <= at) & (at < runs[:, 0] + runs[:, 1])].tolist():
                    ids = np.frombuffer(row["ids"], kind)[start : start + tokens].astype("<u4")
                    out.append((row["doc_id"], row["start"] + start, tokens, zlib.crc32(ids), row["doc_tokens"], sequence + at - rank, offset))
            names = [f.split()[0] for f in _OUT.split(", ")]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(names, zip(*out) if out else [()] * 7)})

    numbered = items.drop("ids").join(bases, ["length", "part"]).mapInArrow(place_whole, _OUT)
    if not places.cut:
        return numbered
    lengths = F.col("length").isin(list(places.cut))
    return numbered.unionByName(items.where(lengths).join(bases.where(lengths), ["length", "part"]).mapInArrow(place_cut, _OUT))


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    return pack(stored(heads_and_wholes(documents, tokenizer, capacity, end_id), "pieces"), capacity, id_type(tokenizer, end_id))

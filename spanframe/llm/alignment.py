"""Operator 13: alignment of two tokenizers' tokens by byte ranges, with corpus-wide counts of linked id pairs under a minimal perfect hash.

Each text is encoded once by both tokenizers and checked byte for byte; the ids go to a stored table. First pass: documents are aligned, and each task
gives its distinct id pairs with their numbers of links. The distinct pairs of all tasks are dealt over buckets, and a minimal perfect hash function of each bucket goes
to the shared folder together with its keys. The tasks' numbers become dense vectors indexed by that hash, which a tree of sums over FAN tasks or vectors at a
time adds up to one vector for each bucket. Second pass: documents are aligned again, and every link looks its count up in the mapped files, with its key verified.

Two tokens are linked where their byte ranges overlap. Each stretch between neighbouring token ends of either side lies in one token of each,
and each overlapping pair has one such stretch; so links are the merged ends, and groups the ends in common.

Nothing is broadcast but a table of one number for each id of the second vocabulary. Pairs are bounded by the vocabularies, whatever the size of the corpus, and are mapped, not loaded.

Defined results: a text that is null or empty, or whose joined token bytes differ from a blank and the text, has no tokens: zeros and an empty string; rows that
repeat a doc_id, or have none, are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm import arrays as A
from spanframe.llm import perfect_hash as H
from spanframe.llm.common import bound_batches, mounted, release_memory, shared_path, stored, text_blocks
from spanframe.llm.piece_tokens import TokenBytes, piece_encoder, plain_byte_encoder

#: Vectors that one step of the tree adds up; distinct pairs that a task holds before it hands them on.
FAN, HELD = 16, 1 << 21


def _type(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def _packed(flat: np.ndarray, edges: np.ndarray, kind: str) -> pa.Array:
    """A binary column of each document's ids."""
    data = np.ascontiguousarray(flat.astype(kind))
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    data, ends = A.raw(column.cast(pa.large_binary()).fill_null(b""))
    return data.view(kind).astype(np.int64), ends // np.dtype(kind).itemsize


def _picked(flat: np.ndarray, edges: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with the documents that are not kept made empty."""
    lengths = np.diff(edges)
    return flat[np.repeat(keep, lengths)], np.concatenate([[0], np.cumsum(lengths * keep)])


def _same(table: TokenBytes, flat: np.ndarray, edges: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Documents whose joined token bytes are their text's bytes."""
    sizes = np.concatenate([[0], np.cumsum(table.sizes[flat])])[edges]
    same = np.diff(sizes) == np.diff(ends)
    if same.all():
        wrong = np.concatenate([[0], np.cumsum(table.joined(flat) != data)])
        return same & (np.diff(wrong[ends]) == 0)
    for i in np.flatnonzero(same):
        same[i] = np.array_equal(table.joined(flat[edges[i] : edges[i + 1]]), data[ends[i] : ends[i + 1]])
    return same


def encoded(documents: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id, a, b): packed ids of both tokenizers, empty for texts without tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, one_bytes), (two, two_bytes) = plain_byte_encoder(first), piece_encoder(second)
        for block in text_blocks(batches):
            text = block.column("text")
            full = pc.binary_length(text).to_numpy(zero_copy_only=False) > 0
            spaced = pc.if_else(pa.array(full), pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), text, pa.scalar(b"", pa.large_binary())), pa.scalar(b"", pa.large_binary()))
            data, ends = A.raw(spaced)
            a, a_edges = one.encode(spaced)
            b, b_edges = two.encode(text)
            keep = full & _same(one_bytes, a, a_edges, data, ends) & _same(two_bytes, b, b_edges, data, ends)
            sides = (_packed(*_picked(x, e, keep), _type(len(t))) for x, e, t in ((a, a_edges, one_bytes), (b, b_edges, two_bytes)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *sides], ["doc_id", "a", "b"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, a binary, b binary")


class Aligned:
    """Links and groups of the documents of a batch."""

    def __init__(self, batch: pa.RecordBatch, one: TokenBytes, two: TokenBytes):
        self.a, self.a_edges = _unpacked(batch.column("a"), _type(len(one)))
        self.b, self.b_edges = _unpacked(batch.column("b"), _type(len(two)))
        self.a_ends, self.b_ends = np.cumsum(one.sizes[self.a]), np.cumsum(two.sizes[self.b])
        ends = np.concatenate([self.a_ends, self.b_ends])
        ends.sort(kind="stable")
        self.ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
        #: Index of the token of either side in each link, and links before each document.
        self.link_a, self.link_b = np.searchsorted(self.a_ends, self.ends), np.searchsorted(self.b_ends, self.ends)
        bytes_ = np.concatenate([[0], self.a_ends])[self.a_edges]
        self.link_edges = np.searchsorted(self.ends, bytes_, "right")
        self.link_edges[bytes_ == 0] = 0

    def keys(self) -> np.ndarray:
        """The id pair of each link."""
        return self.a[self.link_a] << 32 | self.b[self.link_b]

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[self.link_edges])

    def last_of_group(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of either side that end where one of the other side ends."""
        at = np.searchsorted(self.b_ends, self.a_ends)
        last_a = self.b_ends[np.minimum(at, len(self.b_ends) - 1)] == self.a_ends if len(self.b_ends) else np.zeros(0, bool)
        last_b = np.zeros(len(self.b_ends), bool)
        last_b[at[last_a]] = True
        return last_a, last_b

    def group_digests(self, digits: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """SHA-256 of each document's groups, written as decimal ids: a1,a2|b1;a3|b2."""
        last_a, last_b = self.last_of_group()
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        stop_a, stop_b = np.concatenate([[0], np.flatnonzero(last_a) + 1]), np.concatenate([[0], np.flatnonzero(last_b) + 1])
        place_a = np.arange(len(self.a)) + stop_b[group_a]
        place_b = np.arange(len(self.b)) + stop_a[group_b + 1]
        chars, sizes = digits
        ids, marks = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        marks[place_a], marks[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        wide, n = chars[ids], sizes[ids]
        wide[np.arange(len(ids)), n] = marks
        text = wide[np.arange(chars.shape[1]) <= n[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(n + 1)])[self.a_edges + self.b_edges].tolist()
        return [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]


def digit_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1 as bytes, with room for a mark behind, and their numbers."""
    width = len(str(max(n - 1, 0)))
    text = np.char.ljust(np.arange(n).astype(f"S{width}"), width + 1)
    return text.view(np.uint8).reshape(n, width + 1), np.char.str_len(np.arange(n).astype(f"S{width}")).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)


def link_counts(tokens: DataFrame, first: str, second: str) -> DataFrame:
    """(part, slot, key, n): the distinct pairs of each task with their numbers of links."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, part = plain_byte_encoder(first)[1], piece_encoder(second)[1], TaskContext.get().partitionId()
        keys, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def given(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):
                own = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"part": np.full(len(own), part, np.int32), "slot": H.slot(own).astype(np.int32), "key": own, "n": counts[i : i + (1 << 16)]})

        for batch in batches:
            new = np.unique(Aligned(batch, one, two).keys(), return_counts=True)
            waiting.append(new)
            size += len(new[0])
            if size > HELD:
                keys, counts = _summed(*(np.concatenate(x) for x in zip((keys, counts), *waiting)))
                waiting, size = [], 0
                if len(keys) > HELD:
                    yield from given(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield from given(*_summed(*(np.concatenate(x) for x in zip((keys, counts), *waiting))))
        release_memory()

    return tokens.select("a", "b").mapInArrow(rows, "part int, slot int, key long, n long")


def build_functions(pairs: DataFrame, folder: str, buckets: int) -> DataFrame:
    """(bucket, keys): writes the perfect hash function of each bucket's distinct keys to the folder."""

    def build(table: pa.Table) -> pa.Table:
        function = H.PerfectHash.build(table.column("key").to_numpy())
        number = table.column("bucket")[0].as_py()
        H.save(folder, number, sizes=function.sizes, words=function.words, ranks=function.ranks, keys=function.keys)
        return pa.table({"bucket": pa.array([number], pa.int32()), "keys": pa.array([len(function.keys)], pa.int64())})

    return pairs.groupBy("bucket", "key").agg(F.lit(1).alias("one")).select("bucket", "key").groupBy("bucket").applyInArrow(build, "bucket int, keys long")


def summed_vectors(pairs: DataFrame, folder: str, parts: int) -> DataFrame:
    """(bucket, node, vector): dense vectors of FAN tasks' numbers, then added up by a tree, FAN at a time, to one for each bucket."""
    schema = "bucket int, node int, vector binary"

    def given(key: tuple, vector: np.ndarray) -> pa.Table:
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int32()), "vector": pa.array([vector.astype("<i8").tobytes()], pa.binary())})

    def leaf(key: tuple, table: pa.Table) -> pa.Table:
        function = H.opened(folder, key[0].as_py())
        at = function.index(table.column("key").to_numpy())
        vector = np.zeros(len(function.keys), np.int64)
        np.add.at(vector, at, table.column("n").to_numpy())
        return given(key, vector)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        return given(key, sum(np.frombuffer(v.as_py(), "<i8") for v in table.column("vector")))

    vectors, nodes = pairs.groupBy("bucket", F.floor(F.col("part") / FAN).cast("int").alias("node")).applyInArrow(leaf, schema), -(-parts // FAN)
    while nodes > 1:
        vectors, nodes = vectors.select("bucket", F.floor(F.col("node") / FAN).cast("int").alias("node"), "vector").groupBy("bucket", "node").applyInArrow(add, schema), -(-nodes // FAN)
    return vectors


class PairCounts:
    """Files of the counts: their folder, number of buckets, and the highest count of each id of the second vocabulary."""

    def __init__(self, folder: str, buckets: int, best: np.ndarray):
        self.folder, self.buckets, self.best = folder, buckets, best

    def of(self, keys: np.ndarray) -> np.ndarray:
        return H.look_up(self.folder, self.buckets, "counts", keys)

    def table(self, spark) -> DataFrame:
        """(a_id, b_id, links, best): all pairs."""
        folder, best = self.folder, self.best

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number in (x for batch in batches for x in batch.column("id").to_pylist()):
                if (keys := H.load(folder, number, "keys")) is not None:
                    counts = H.load(folder, number, "counts")
                    for i in range(0, len(keys), 1 << 16):
                        k, n = np.array(keys[i : i + (1 << 16)]), np.array(counts[i : i + (1 << 16)])
                        yield pa.RecordBatch.from_pydict({"a_id": k >> 32, "b_id": k & 0xFFFFFFFF, "links": n, "best": pa.array(n == best[k & 0xFFFFFFFF])})

        return spark.range(0, self.buckets, 1, self.buckets).mapInArrow(rows, "a_id long, b_id long, links long, best boolean")


def count_pairs(tokens: DataFrame, first: str, second: str) -> PairCounts:
    """Corpus-wide numbers of links of all id pairs of a stored table of tokens."""
    spark, folder = tokens.sparkSession, mounted(shared_path(tokens.sparkSession, "pair-counts"))
    partial = stored(link_counts(tokens, first, second), "links")
    size = partial.agg(F.count_distinct("key").alias("n"), F.max("part").alias("last")).first()
    buckets = max(1, min(H.SLOTS, -(-size["n"] // H.BUCKET_KEYS)))
    pairs = partial.select(F.floor(F.col("slot") * F.lit(buckets).cast("long") / H.SLOTS).cast("int").alias("bucket"), "part", "key", "n")
    built = build_functions(pairs, folder, buckets).agg(F.sum("keys")).first()[0] or 0
    if built != size["n"]:
        raise RuntimeError(f"{built} pairs hashed of {size['n']}")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, vector in zip(batch.column("bucket").to_pylist(), batch.column("vector")):
                counts = np.frombuffer(vector.as_py(), "<i8")
                H.save(folder, number, counts=counts)
                second_ids = np.asarray(H.load(folder, number, "keys")) & 0xFFFFFFFF
                best = np.zeros(int(second_ids.max(initial=0)) + 1, np.int64)
                np.maximum.at(best, second_ids, counts)
                own = np.flatnonzero(best)
                yield pa.RecordBatch.from_pydict({"b_id": own, "n": best[own]})

    last = -1 if size["last"] is None else size["last"]
    vectors = summed_vectors(pairs, folder, last + 1).mapInArrow(finish, "b_id long, n long")
    best = np.zeros(len(piece_encoder(second)[1]), np.int64)
    for row in vectors.groupBy("b_id").agg(F.max("n").alias("n")).toLocalIterator():  # one for each id of the second vocabulary at most
        best[row["b_id"]] = row["n"]
    return PairCounts(folder, buckets, best)


def look_up_links(tokens: DataFrame, first: str, second: str, counts: PairCounts) -> DataFrame:
    """The second pass: one row for each document."""
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = plain_byte_encoder(first)[1], piece_encoder(second)[1]
        digits = digit_table(max(len(one), len(two)))
        for batch in batches:
            own = Aligned(batch, one, two)
            keys, inverse = np.unique(own.keys(), return_inverse=True)
            number = counts.of(keys)
            highest = (number == counts.best[keys & 0xFFFFFFFF])[inverse]
            n_a, n_b, n_links = np.diff(own.a_edges), np.diff(own.b_edges), np.diff(own.link_edges)
            values = (n_a, n_b, n_a + n_b - n_links, n_links, own.per_document(highest), own.per_document(number[inverse]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | dict(zip(names, values)) | {"groups_sha256": own.group_digests(digits)})
        release_memory()

    return tokens.mapInArrow(rows, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", groups_sha256 string")


def align_documents(documents: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    bound_batches(documents.sparkSession)
    tokens = stored(encoded(documents, first, second), "tokens")
    return look_up_links(tokens, first, second, count_pairs(tokens, first, second))

"""Operator 7: n-gram Jaccard join by size-aware heavy and light sets.

A document's set holds its distinct word n-grams, as 64-bit hashes; equal sets are one node, named by a 128-bit hash. Two sets link if
``100 * intersection >= PERCENT * union``. Light (small) sets enumerate their subsets of every size that a link can need: sets with a common
subset large enough for their sizes are linked, no check needed. Heavy sets are found through inverted lists of their rarest elements (a
link shares two of them) and verified on the whole sets. The boundary between light and heavy is where the estimated cost,
over the measured distribution of sizes, is least.

Lists are never turned into all their pairs. First every member meets the list's most central member (fewest rarer elements before the common
one), and links join components. Then members that are still in different components, and whose places in the list allow a link, are paired
and verified: every link between different components is found, so components are exact. How common an element is only decides the order of
elements; it comes from a table of bucket counts over all documents of a fixed size, so any count gives right results. Before whole sets are
fetched, bitmaps that bound the number of differing elements rule out most pairs that only share some rare element.

Defined results: null texts and texts without words have an empty set, link with nothing and form a component of their own (component_id
is their doc_id); fewer than n words are one n-gram; rows with a null doc_id take part, and their component_id is the least id that is
not null, if any; rows with a repeated doc_id are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm import arrays as A
from spanframe.llm.common import shared_path, stored, text_blocks
from spanframe.llm.graph import components
from spanframe.llm.tables import SLICE, fold_table, table_rows

#: Bits of the table of bucket counts, and the count from which elements are ordered by hash alone.
TABLE_BITS, MOST_COUNT = 22, (1 << 16) - 1
#: Common rare elements that a candidate pair must have: prefixes are as much longer that every link has them.
COMMON = 2
#: Most bits of the filter that keeps whole sets of documents without candidates from being shuffled.
FILTER_BITS = 26
_ORDER = np.uint64(64 - TABLE_BITS)


def need(size: int, percent: int) -> int:
    """Elements that a set must share with any set it links with."""
    return -(-percent * size // 100)


def set_blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For each block of texts: the rows, the elements of their sets (ascending in each), and where each set begins."""
    for block in text_blocks(batches):
        data, ends = A.raw(block.column("text"))
        data = A.LOWER[data]
        starts, stops, docs = A.runs(~A.SPACE[data], ends)
        words = A.span_hash(A.prefix_hash(data), starts, stops)
        count = np.bincount(docs, minlength=len(ends) - 1)
        h, at = A.shingles(words, docs, n)
        of = docs[at]
        if len(few := np.flatnonzero((count > 0) & (count < n))):
            first = np.searchsorted(docs, few)
            short = np.array([A.mix(np.array([sum(int(w) * (2 * k + 3) for k, w in enumerate(words[a : a + count[d]])) + int(count[d]) & (1 << 64) - 1], np.uint64))[0] for a, d in zip(first, few)], np.uint64)
            h, of = np.concatenate([h, short]), np.concatenate([of, few])
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
        yield block, h, np.searchsorted(of, np.arange(len(ends)))


def names(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """128-bit names of the sets, two numbers each: sums of mixed elements, mixed with the size."""
    n = np.diff(places).astype(np.uint64)
    one, two = _sums(h, places)
    return np.stack([A.mix(one + n), A.mix(two ^ (n << np.uint64(32)))], 1)


def _sums(h: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for values in _mixed(h):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        out.append(total[places[1:]] - total[places[:-1]])
    return out[0], out[1]


def _mixed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return A.mix(h + np.uint64(0x51ED270B)), A.mix(h ^ np.uint64(0xA24BAED4963EE407))


def parities(h: np.ndarray, places: np.ndarray) -> pa.Array:
    """A bitmap for each set, of the power of two from half its size: every element flips one bit.

    Two sets differ in at least as many elements as their bitmaps differ in bits; a bitmap folds to half its length by xor.
    """
    size = np.diff(places)
    words = 1 << np.ceil(np.log2(np.maximum(size / 128, 1))).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(begins[-1], np.uint64)
    of = np.repeat(np.arange(len(size)), size)
    at = (h & (64 * words[of] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(out, begins[of] + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(out.view(np.int64)))


def _binary(pairs: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(pairs)], pa.binary())


def measure(documents: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of elements by bucket, and of sets by size (the last for all larger ones), over all documents."""
    buckets = 1 << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(buckets + SLICE, np.int32)
        for _, h, places in set_blocks(batches, n):
            np.add.at(table, (h >> _ORDER).astype(np.int64), np.int32(1))
            table[buckets:] += np.bincount(np.minimum(np.diff(places), SLICE - 1), minlength=SLICE).astype(np.int32)
        yield table_rows(table)

    got = fold_table(documents.select("text").mapInArrow(count, "slot int, salt int, counts binary"), np.add, buckets + SLICE)
    return got[:buckets], got[buckets:]


def boundary(sizes: np.ndarray, percent: int) -> int:
    """The largest size of a light set: enumerated subsets of light sets plus list entries and checks of heavy ones cost least."""
    most = min(60, len(sizes) - 1)
    subsets = [sum(comb(a, k) for k in range(a - need(a, percent) + 1)) for a in range(most + 1)]
    lists = [(a - need(a, percent) + 1) * (1 + a) for a in range(most + 1)]
    costs = [sum(int(sizes[a]) * (subsets[a] if a <= x else lists[a]) for a in range(1, most + 1)) for x in range(most + 1)]
    return int(np.argmin(costs)) if sum(sizes[1 : most + 1]) else 0


def keys(documents: DataFrame, n: int, percent: int, counts: np.ndarray, light: int) -> DataFrame:
    """The stored result of one pass: kind 0 rows (doc_id, size, name, bits), kind 1 subsets of light sets, kind 2 list entries.

    Subsets carry their size as ``place`` and two hashes as ``key`` and ``more``; list entries carry the element and its place among the set's.
    """
    levels = documents.sparkSession.sparkContext.broadcast(np.minimum(counts, MOST_COUNT).astype(np.uint16))  # of a fixed size
    least_light = need(light + 1, percent)  # light sets from this size on may link with heavy ones

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, h, places in set_blocks(batches, n):
            size, name = np.diff(places), names(h, places)
            zero = np.zeros(len(size), np.int64)
            yield _rows(0, block.column("doc_id").cast(pa.int64()), size, name, zero, zero, zero, parities(h, places))
            one, two = _mixed(h)
            whole = _sums(h, places)
            out: list[tuple] = []
            for d in np.flatnonzero((size > 0) & (size <= light)):
                a, b = places[d], places[d + 1]
                for left in range(int(size[d]) - need(int(size[d]), percent) + 1):
                    for gone in combinations(range(a, b), left):
                        minus = [sum(int(x[g]) for g in gone) for x in (one, two)]
                        out.append((d, int(size[d]) - left, *(np.int64(((int(w[d]) - m) & (1 << 64) - 1) - (1 << 63)) for w, m in zip(whole, minus))))
            if out:
                d, place, key, more = (np.array(x, np.int64) for x in zip(*out))
                yield _rows(1, None, size[d], name[d], key, place, more)
            want = np.where(size >= max(least_light, 1), size - -(-percent * size // 100) + COMMON, 0)
            of = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, levels.value[(h >> _ORDER).astype(np.int64)], of))
            at = np.arange(len(h)) - places[of]
            use = at < want[of]
            if use.any():
                yield _rows(2, None, size[of[use]], name[of[use]], h[order][use].view(np.int64), at[use], np.zeros(int(use.sum()), np.int64))

    def _rows(kind: int, doc, size, name, key, place, more, bits=None) -> pa.RecordBatch:
        none = pa.nulls(len(size), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(size), kind), pa.int32()), none if doc is None else doc, pa.array(size, pa.int64()), _binary(name), pa.array(key, pa.int64()), pa.array(place, pa.int64()),
                pa.array(more, pa.int64()), pa.nulls(len(size), pa.list_(pa.int64())) if bits is None else bits,
            ],
            names=["kind", "doc_id", "size", "name", "key", "place", "more", "bits"],
        )

    spark, path = documents.sparkSession, shared_path(documents.sparkSession, "sets")
    documents.select("doc_id", "text").mapInArrow(rows, "kind int, doc_id long, size long, name binary, key long, place long, more long, bits array<bigint>").write.partitionBy("kind").parquet(path)
    return spark.read.schema("doc_id long, size long, name binary, key long, place long, more long, bits array<bigint>, kind int").parquet(path)


def linked(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (a + b - shared)


def light_links(table: DataFrame, percent: int) -> DataFrame:
    """(a, b) from common subsets: every set of a subset meets the smallest one, which links with it if any does."""
    own = table.where("kind = 1").select("key", "more", "place", "size", "name").distinct()
    lead = own.groupBy("key", "more", "place").agg(F.min(F.struct("size", "name")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    met = own.join(lead, ["key", "more", "place"]).where(F.col("name") != F.col("lead.name")).where(linked(F.col("place"), F.col("size"), F.col("lead.size"), percent))
    return met.select(F.col("lead.name").alias("a"), F.col("name").alias("b"))


def feasible(i: Column, n: Column, j: Column, m: Column, percent: int) -> Column:
    """Whether sets of sizes n and m can link one of whose first COMMON common elements is the i-th and j-th of theirs."""
    return linked(F.least(n - i, m - j) + (COMMON - 1), n, m, percent)


def candidates(met: DataFrame, a: str, b: str, n: str, m: str, percent: int) -> DataFrame:
    """Pairs that met at COMMON elements (fewer only where a link needs fewer)."""
    least = F.least(F.lit(COMMON), F.ceil(F.least(F.col(n), F.col(m)) * percent / 100))
    pairs = met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), least.cast("int").alias("_least"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("_n"), F.min("_least").alias("_least")).where("_n >= _least").select("a", "b")


def lists(table: DataFrame) -> DataFrame:
    """Stored list entries (key, place, size, name) of elements that at least two entries have."""
    own = table.where("kind = 2").select("key", "place", "size", "name")
    shared = own.groupBy("key").count().where("count > 1").select("key")
    return stored(own.join(shared, "key", "left_semi").distinct(), "lists")


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    lead = entries.groupBy("key").agg(F.min(F.struct("place", "size", "name")).alias("lead"))
    met = entries.join(lead, "key").where(F.col("name") != F.col("lead.name"))
    met = met.where(feasible(F.col("place"), F.col("size"), F.col("lead.place"), F.col("lead.size"), percent))
    return candidates(met, "name", "lead.name", "size", "lead.size", percent)


def rest_pairs(entries: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that a list allows to link."""
    own = entries.join(roots, entries.name == roots.node, "left").select("key", "place", "size", "name", F.coalesce("root", "name").alias("root"))
    own = stored(own, "entries")
    mixed = own.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    own = stored(own.join(mixed, "key", "left_semi"), "entries")
    other = own.select("key", *(F.col(c).alias(f"{c}2") for c in ("place", "size", "name", "root")))
    met = own.join(other, (own.key == other.key) & (F.col("root") < F.col("root2")) & feasible(F.col("place"), F.col("size"), F.col("place2"), F.col("size2"), percent))
    return candidates(met, "name", "name2", "size", "size2", percent)


def plausible(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps do not rule a link out."""
    own = table.where("kind = 0 and size > 0").groupBy("name").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    one = own.select(F.col("name").alias("a"), F.col("size").alias("n"), F.col("bits").alias("x"))
    two = own.select(F.col("name").alias("b"), F.col("size").alias("m"), F.col("bits").alias("y"))
    flip = lambda p, q: F.zip_with(p, q, lambda u, v: u.bitwiseXOR(v))
    fold = lambda p, q: F.when(F.size(p) > F.size(q), flip(F.slice(p, F.lit(1), F.size(q)), F.slice(p, F.size(q) + 1, F.size(q)))).otherwise(p)
    differ = F.aggregate(flip(fold(F.col("x"), F.col("y")), fold(F.col("y"), F.col("x"))), F.lit(0), lambda total, word: total + F.bit_count(word))
    met = pairs.join(one, "a").join(two, "b")
    return met.where((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("m"))).select("a", "b")


def whole_sets(documents: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Stored (name, elements) of the sets in pairs: documents pass a filter of fixed size before their sets are shuffled."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "wanted")
    bits = int(min(FILTER_BITS, max(15, np.ceil(np.log2(16 * wanted.count() + 1)))))
    places = lambda raw: (np.frombuffer(raw, np.uint64).reshape(-1, 2) >> np.uint64(64 - bits)).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            at = places(b"".join(batch.column(0).to_pylist())).ravel()
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        padded = np.zeros(-(-len(table) // (8 * SLICE)) * 8 * SLICE, np.uint8)
        padded[: len(table)] = table
        yield table_rows(padded.view(np.int64))

    marked = fold_table(wanted.mapInArrow(mark, "slot int, salt int, counts binary"), np.bitwise_or, max(SLICE, 1 << bits >> 6)).view(np.uint8)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for _, h, begins in set_blocks(batches, n):
            name = names(h, begins)
            at = places(name.tobytes())
            hit = ((marked[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1) & (np.diff(begins) > 0)
            own = [d for d in np.flatnonzero(hit) if (k := name[d].tobytes()) not in done and not done.add(k)]
            if len(done) > 200_000:
                done.clear()
            if own:
                yield pa.RecordBatch.from_pydict({"name": [name[d].tobytes() for d in own], "elements": pa.array([h[begins[d] : begins[d + 1]].view(np.int64) for d in own], pa.list_(pa.int64()))})

    found = documents.select("text").mapInArrow(sets, "name binary, elements array<bigint>")
    return stored(found.join(wanted, "name", "left_semi").groupBy("name").agg(F.first("elements").alias("elements")), "whole")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets link."""
    one = sets.select(F.col("name").alias("a"), F.col("elements").alias("x"))
    two = sets.select(F.col("name").alias("b"), F.col("elements").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(linked(shared, F.size("x"), F.size("y"), percent)).select("a", "b")


def jaccard_components(documents: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    counts, sizes = measure(documents, n)
    table = keys(documents, n, percent, counts, boundary(sizes, percent))
    entries = lists(table)
    pairs = stored(plausible(star_pairs(entries, percent), table, percent), "pairs")
    links = stored(light_links(table, percent).union(verified(pairs, whole_sets(documents, pairs, n), percent)), "links")
    roots = stored(components(links), "roots")
    rest = stored(plausible(rest_pairs(entries, roots, percent), table, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = stored(verified(rest, whole_sets(documents, rest, n), percent), "links")
    if not more.isEmpty():
        roots = stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "roots")
    rows = table.where("kind = 0").select("doc_id", "size", "name")
    nodes = rows.where("size > 0").groupBy("name").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(roots, nodes.name == roots.node, "left").select("name", F.coalesce("root", "name").alias("root"), "least")
    nodes = stored(nodes, "nodes")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("name", "component_id")
    return rows.join(named, "name", "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

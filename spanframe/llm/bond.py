"""Operator 11: hard negatives by BOND's vertical scan of vector columns.

Vectors become whole numbers, floor(256 * x), and are cut into blocks of rows; a block is held by dimension. An anchor reads a block's
dimensions in descending order of its own magnitudes. After each step the least and the most that the dimensions not yet read can add, from
the block's minimum and maximum by dimension, bound every score; rows that can no longer be among the results leave the candidate bitmap. What is left at the
last dimension has exact scores. Two scans: the nearest rows of the anchor's label give the score windows, the second scan fills them. Results found in earlier
blocks of a task carry over as bounds, so later blocks shrink sooner.

Spark pairs blocks of anchors with blocks of rows by keys (a stated query set against all rows), streams each pair sorted through one task
with memory for one block of anchors and one of rows, and merges the few results of each pair by ranks. Nothing is broadcast.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no part; vectors are compared with those of the same
number of components; a row with the anchor's own id is the anchor itself; rows that repeat an id count each, and repeated anchors give
repeated results; components beyond +-2^17 count as that, so that scores fit 64 bits (up to 8192 components); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import bound_batches, stored

#: Anchors of a block; components of a block of rows held at once; fewest and most rows of a task.
ANCHORS, COMPONENTS, FEWEST, MOST = 2048, 1 << 18, 2048, 1 << 20
#: Largest whole-number component.
LIMIT = 1 << 25
#: Shares of the needed score (of all dimensions, where none is needed yet) that the dimensions not yet read may add when bounds are taken.
STEPS = (0.5, 0.2, 0.08)
_NONE = np.iinfo(np.int64).min


def whole_numbers(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, dim, v) of the rows that take part; v is the components as little-endian 32-bit integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            offsets = np.asarray(lists.offsets)
            flat = lists.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            keep = np.flatnonzero(bad[offsets[1:]] == bad[offsets[:-1]])
            whole = np.floor(256.0 * np.nan_to_num(flat, nan=0.0, posinf=0.0, neginf=0.0)).clip(-LIMIT, LIMIT).astype("<i4")
            packed = pa.array([whole[offsets[i] : offsets[i + 1]].tobytes() for i in keep], pa.binary())
            own = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_pydict({"vec_id": own.column("vec_id"), "label": own.column("label"), "dim": pa.array(np.diff(offsets)[keep], pa.int32()), "v": packed})

    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding").where("vec_id is not null and label is not null and embedding is not null")
    return ready.mapInArrow(rows, "vec_id long, label long, dim int, v binary")


class Block:
    """Rows by dimension, with the least and largest value of each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, np.ascontiguousarray(values.T)
        self.low, self.high = self.columns.min(1), self.columns.max(1)

        self._other: dict[int, np.ndarray] = {}

    def of_other_label(self, label: int) -> np.ndarray:
        """Rows of any other label; the answer for the last labels asked is kept."""
        if label not in self._other:
            if len(self._other) >= 64:
                self._other.clear()
            self._other[label] = self.labels != label
        return self._other[label]

    def of(self, rows: np.ndarray) -> Block:
        return Block(self.ids[rows], self.labels[rows], self.columns[:, rows].T)


def exact_type(queries: np.ndarray, rows: np.ndarray) -> type:
    """The fastest number type in which all sums of products are exact."""
    most = max(1, queries.shape[1]) * int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def vertical(block: Block, q: np.ndarray, need: int, prune) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of the candidates left; ``prune(low, high, rows)`` says which may stay, given bounds of their scores (rows is None for all).

    Bounds are taken where the dimensions not yet read can add at most the shares STEPS of the score that is needed.
    """
    d = len(q)
    order = np.argsort(-np.abs(q), kind="stable")
    ordered = q[order]
    a, b = ordered * block.low[order], ordered * block.high[order]
    rest_low, rest_high = np.zeros(d + 1, q.dtype), np.zeros(d + 1, q.dtype)
    rest_low[:d], rest_high[:d] = np.minimum(a, b)[::-1].cumsum()[::-1], np.maximum(a, b)[::-1].cumsum()[::-1]
    stops = [int(np.searchsorted(-rest_high, -s * need)) for s in STEPS] if need > 0 else [int(d * (1 - s)) for s in STEPS]
    alive = rows = None
    score, at = np.zeros(len(block.ids), q.dtype), 0
    for stop in sorted({*stops, d} - {0}):
        dims = order[at:stop]
        score += ordered[at:stop] @ (block.columns[dims] if rows is None else block.columns[dims[:, None], rows])
        at = stop
        if stop == d:
            break
        stay = prune(score + rest_low[stop], score + rest_high[stop], rows)
        kept = np.count_nonzero(stay)
        if rows is None:
            alive = stay
            if 4 * kept <= len(stay):
                rows = np.flatnonzero(stay)
                score = score[rows]
        elif 2 * kept <= len(rows):
            rows, score = rows[stay], score[stay]
        if not kept:
            return np.zeros(0, np.int64), np.zeros(0, q.dtype)
    if rows is None:
        rows = np.arange(len(score)) if alive is None else np.flatnonzero(alive)
        score = score[rows]
    return rows, score


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best: higher scores first, ties by smaller id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))


class Nearest:
    """The k best rows of an anchor's own label."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, block: Block, q: np.ndarray, own: int) -> None:
        carried = int(self.scores[-1]) if len(self.scores) == self.k else _NONE

        def prune(low, high, rows):
            least = carried
            if len(low) > self.k:  # the anchor itself may be among them
                least = max(least, int(np.partition(low, len(low) - self.k - 1)[len(low) - self.k - 1]))
            return high >= least

        rows, scores = vertical(block, q, carried, prune)
        other = block.ids[rows] != own
        ids, scores = np.concatenate([self.ids, block.ids[rows[other]]]), np.concatenate([self.scores, scores[other].astype(np.int64)])
        best = first(scores, ids, self.k)
        self.ids, self.scores = ids[best], scores[best]


class Windowed:
    """The k best rows of other labels in each score window [low, high]."""

    def __init__(self, k: int, windows: list[tuple[int, int]]):
        self.k, self.low, self.high = k, [w[0] for w in windows], [w[1] for w in windows]
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]

    def meet(self, block: Block, q: np.ndarray, label: int) -> None:
        k, other = self.k, block.of_other_label(label)
        carried = [max(low, int(s[-1])) if len(s) == k else low for low, (_, s) in zip(self.low, self.found)]
        lowest, highest = min(carried), max(self.high)

        def prune(low, high, rows):
            stay = (high >= lowest) & (low <= highest) & (other if rows is None else other[rows])
            at = np.flatnonzero(stay)
            low, high, keep = low[at], high[at], np.zeros(len(at), bool)
            for a, b, least in zip(self.low, self.high, carried):
                sure = low[(low >= a) & (high <= b)]
                if len(sure) >= k:
                    least = max(least, int(np.partition(sure, len(sure) - k)[len(sure) - k]))
                keep |= (high >= least) & (low <= b)
            stay[at] = keep
            return stay

        rows, scores = vertical(block, q, lowest, prune)
        own = other[rows]
        rows, scores = rows[own], scores[own].astype(np.int64)
        for i, (ids, own) in enumerate(self.found):
            inside = (scores >= carried[i]) & (scores <= self.high[i])
            if inside.any():
                ids, own = np.concatenate([ids, block.ids[rows[inside]]]), np.concatenate([own, scores[inside]])
                best = first(own, ids, k)
                self.found[i] = ids[best], own[best]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether a new pair of blocks begins, rows of one kind of one pair), in order."""
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "ab", "rb", "kind")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                key = tuple(keys[:3, a].tolist())
                yield key != last, batch.slice(a, b - a)
                last = key


def _scan(batches: Iterator[pa.RecordBatch], start, meet, rows_of) -> Iterator[pa.RecordBatch]:
    """Streams pairs of blocks: ``start(anchor row)`` makes an anchor's state, ``meet(states, queries, block)`` adds a block, ``rows_of(states)`` gives results."""
    anchors: list[pa.RecordBatch] = []
    waiting: list[pa.RecordBatch] = []
    states = queries = None

    def flush() -> None:
        nonlocal states, queries
        if states is None:
            dim = int(anchors[0].column("dim")[0].as_py())
            queries = np.concatenate([_matrix(x.column("v"), dim) for x in anchors])
            states = [start(row) for x in anchors for row in x.drop_columns(["v"]).to_pylist()]
        if waiting:
            dim = queries.shape[1]
            values = np.concatenate([_matrix(x.column("v"), dim) for x in waiting])
            kind = exact_type(queries, values)
            block = Block(*(np.concatenate([x.column(c).to_numpy() for x in waiting]) for c in ("id", "label")), values.astype(kind))
            waiting.clear()
            meet(states, queries.astype(kind), block)

    for new, part in _groups(batches):
        if new:
            if anchors:
                flush()
                yield from rows_of(states)
            anchors, states = [], None
            waiting.clear()
        if part.column("kind")[0].as_py() == 0:
            anchors.append(part)
        elif anchors:
            waiting.append(part)
            if sum(x.num_rows for x in waiting) * max(1, part.column("dim")[0].as_py()) >= COMPONENTS:
                flush()
    if anchors:
        flush()
        yield from rows_of(states)


def _paired(rows: DataFrame, anchors: DataFrame, n: int, m: int, windows: Column) -> DataFrame:
    """Both sides under the keys of all pairs of blocks, a pair's anchors before its rows."""
    context = rows.sparkSession.sparkContext
    many = max(1, -(-m // ANCHORS))
    parts = max(-(-n // MOST), min(-(-2 * context.defaultParallelism // many), -(-n // FEWEST)), 1)
    number = F.monotonically_increasing_id()
    left = anchors.select("dim", F.pmod("a", F.lit(many)).cast("int").alias("ab"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("rb"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "label", "a", "v", windows.alias("windows"))
    numbered = rows.select("*", F.pmod(number, F.lit(parts)).cast("int").alias("rb"))
    right = numbered.select("dim", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("ab"), "rb", F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "label", F.lit(None).cast("long").alias("a"), "v", F.lit(None).cast("array<struct<k:int,id:long,score:long>>").alias("windows"))
    return left.unionByName(right).repartition(max(1, many * parts), "dim", "ab", "rb").sortWithinPartitions("dim", "ab", "rb", "kind")


def nearest_of_label(rows: DataFrame, anchors: DataFrame, n: int, m: int, k: int) -> DataFrame:
    """(a, k, id, score): the k best rows of each anchor's label, from 1."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def meet(states, queries, block):
            for label in {s[1] for s in states}:
                own = np.flatnonzero(block.labels == label)
                if len(own):
                    part = block.of(own)
                    for (_, mine, best, anchor), q in zip(states, queries):
                        if mine == label:
                            best.meet(part, q, anchor)

        def rows_of(states):
            flat = [(a, int(i), int(s)) for a, _, best, _ in states for i, s in zip(best.ids, best.scores)]
            yield pa.RecordBatch.from_pydict(dict(zip(("a", "id", "score"), (pa.array([x[c] for x in flat], pa.int64()) for c in range(3)))))

        yield from _scan(batches, lambda r: (r["a"], r["label"], Nearest(k), r["id"]), meet, rows_of)

    empty = F.lit(None).cast("array<struct<k:int,id:long,score:long>>")
    found = _paired(rows, anchors, n, m, empty).mapInArrow(scan, "a long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "id"))
    return found.withColumn("k", rank).where(F.col("k") <= k)


def in_windows(rows: DataFrame, anchors: DataFrame, n: int, m: int, k: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors with ``windows``: score between the shares low and high of a positive's."""

    def window(score: int) -> tuple[int, int]:
        return -(-low[0] * score // low[1]), high[0] * score // high[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start(row):
            open_ = [(w, window(w["score"])) for w in row["windows"]]
            open_ = [(w, x) for w, x in open_ if x[0] <= x[1]]
            return row, [w for w, _ in open_], Windowed(k, [x for _, x in open_])

        def meet(states, queries, block):
            for (row, open_, best), q in zip(states, queries):
                if open_:
                    best.meet(block, q, row["label"])

        def rows_of(states):
            flat = [
                (row["a"], w["k"], row["id"], w["id"], w["score"], int(i), int(s))
                for row, open_, best in states for w, (ids, scores) in zip(open_, best.found) for i, s in zip(ids, scores)
            ]
            names = ("a", "k", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
            yield pa.RecordBatch.from_pydict(dict(zip(names, (pa.array([x[c] for x in flat], pa.int64()) for c in range(7)))))

        yield from _scan(batches, start, meet, rows_of)

    found = _paired(rows, anchors, n, m, F.col("windows")).mapInArrow(scan, "a long, k long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("a", "k").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, label: Column, every: int = 50, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """Hard negatives of the rows whose id ``every`` divides: see the module's text. ``low`` and ``high`` are shares (numerator, denominator) of a positive's score."""
    bound_batches(vectors.sparkSession)
    rows = stored(whole_numbers(vectors, label), "vectors")
    anchors = stored(rows.where(F.col("vec_id") % every == 0).withColumn("a", F.monotonically_increasing_id()), "anchors")
    n, m = rows.count(), anchors.count()
    near = stored(nearest_of_label(rows, anchors, n, m, positives), "positives")
    windows = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("k", "id", "score"))).alias("windows"))  # at most ``positives`` rows each
    return in_windows(rows, anchors.join(windows, "a"), n, m, negatives, low, high)

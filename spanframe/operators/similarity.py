"""Similar rows by masked cosine of profile vectors, per layer and over all layers: blocked matrix products.

With masked places as 0 in Z and in M (1 where a place is known), a pair's score needs Z Z' and the norms over shared places, Z^2 M' and M (Z^2)'.
Rows with the same missing places have those norms in common, so a batch of rows is taken by its masks: one product in single precision screens
all pairs against each query's bound, with a margin above its error, and only pairs that pass are scored in double precision. Rows with a mask
that few others have are screened by all three products. Each layer is a slice of the columns; sums over slices are the values of all layers together.

Queries visit every row: blocks of queries and batches of rows are packed once and paired as they are, so what is shuffled grows with the rows,
not with the pairs. A task holds one block and one batch, however many rows pass by, and keeps the best ``k`` of each query. The best of the parts meet in one ranking.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block at most and at least, rows of a batch, rows screened with the same bounds, rows of a part, and rows that set a query's first bound.
QUERIES, FEW_QUERIES, ROWS, STEP, PART, FIRST = 8192, 256, 16384, 4096, 1 << 18, 256
#: Rows of a batch and queries of a block (on average) that share a mask so that they are screened together, masks with scaled queries at hand, and pairs screened or scored at once.
SHARED, TOGETHER, SCALED, TILE, EXACT = 16, 64, 64, 1 << 18, 1 << 12


class _Side:
    """Z, Z^2 and M of some rows, with their identities."""

    def __init__(self, z: np.ndarray, known: np.ndarray, ids: list):
        self.z, self.m, self.square = z, known.astype(float), z * z
        self.ids = np.empty(len(ids), object)
        self.ids[:] = ids

    @classmethod
    def packed(cls, row: Mapping[str, pa.Array], at: int, name: str) -> _Side:
        dims, ids = row[f"{name}_dims"][at].as_py(), row[f"{name}_ids"][at].as_py()
        z = np.frombuffer(row[f"{name}_z"][at].as_buffer(), np.float64).reshape(-1, dims)
        known = np.unpackbits(np.frombuffer(row[f"{name}_known"][at].as_buffer(), np.uint8).reshape(len(z), -1), axis=1, count=dims)
        return cls(z, known, ids)


def _masks(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks and the number of each row's."""
    bits = np.packbits(known > 0, axis=1)
    words = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)
    _, first, which = np.unique(words[:, 0] if words.shape[1] == 1 else words, axis=0, return_index=True, return_inverse=True)
    return known[first], which.ravel()


def _products(a: _Side, b: _Side, places: slice) -> tuple[np.ndarray, ...]:
    """Dot products, squared norms of either side over shared places, and shared places."""
    za, zb, ma, mb = a.z[:, places], b.z[:, places], a.m[:, places], b.m[:, places]
    return za @ zb.T, a.square[:, places] @ mb.T, ma @ b.square[:, places].T, ma @ mb.T


def _cosine(dot: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.maximum(first, 0.0)) * np.sqrt(np.maximum(second, 0.0))
    return np.where(norm > 0, dot / np.where(norm > 0, norm, 1.0), np.nan)


def _places(hit: np.ndarray) -> np.ndarray:
    """Places of the few True of a table, in the order of its rows; eight are looked at together."""
    flat = hit.ravel()
    even = len(flat) // 8 * 8
    at = np.flatnonzero(flat[:even].view(np.uint64))
    near = (8 * at[:, None] + np.arange(8)).ravel()
    return np.concatenate([near[flat[near]], even + np.flatnonzero(flat[even:])])


class _Some:
    """Some rows of a side."""

    def __init__(self, side: _Side, at):
        self.z, self.m, self.square = side.z[at], side.m[at], side.square[at]


class _Best:
    """The best ``k`` rows of each query so far, in order: higher rounded scores first, then earlier rows (the order of identities)."""

    def __init__(self, queries: _Side, k: int, layers: Mapping[str, slice], compared: Sequence[str], least: float, digits: int):
        self.queries, self.k, self.digits, self.unit = queries, k, digits, 10.0**-digits
        self.slices = [layers[n] for n in compared]
        self.places = np.concatenate([np.arange(s.start, s.stop) for s in self.slices])
        self.least = least * len(self.places)
        n = len(queries.z)
        self.order, self.at = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.ids, self.score, self.shared = np.empty((n, k), object), np.zeros((n, k)), np.zeros((n, k), np.int32)
        self.single, self.last, self.scaled = np.zeros((n, k, len(compared))), -1, {}
        own, known = queries.z[:, self.places], queries.m[:, self.places]
        self.live = (own != 0).any(1) & (known.sum(1) >= self.least)  # the others are similar to nothing
        self.masks, self.which = _masks(known)
        self.sorted = np.argsort(self.which, kind="stable")
        self.place = np.argsort(self.sorted)

    def meet(self, rows: _Side, start: int) -> None:
        """Rows that are the next ones of their part from place ``start`` on."""
        low = 0
        while low < len(rows.z) and len(open_ := np.flatnonzero((self.order[:, -1] == -np.inf) & self.live)):
            high = min(low + FIRST, len(rows.z))
            for a in range(0, len(open_), max(1, TILE // FIRST)):
                self._first(open_[a : a + TILE // FIRST], rows, slice(low, high), start)
            rest = np.setdiff1d(np.flatnonzero(self.live), open_)
            if len(rest):
                self._screen(rest, rows, np.arange(low, high), start)
            self.last, low = max(self.last, start + high - 1), high
        while low < len(rows.z):
            high = min(low + min(STEP, max(FIRST, start + low)), len(rows.z))  # as many as were seen, while the bounds still grow fast
            self._screen(np.flatnonzero(self.live), rows, np.arange(low, high), start)
            self.last, low = max(self.last, start + high - 1), high

    def _full(self, asked, rows: _Side, at) -> np.ndarray:
        """Scores of all pairs in double precision, -inf for those that do not count."""
        a, b = _Some(self.queries, asked), _Some(rows, at)
        dot, first, second, shared = (sum(p) for p in zip(*(_products(a, b, s) for s in self.slices)))
        with np.errstate(invalid="ignore", over="ignore"):
            score = _cosine(dot, first, second)
        score[(shared < self.least) | (shared <= 0) | ~np.isfinite(score)] = -np.inf
        return score

    def _first(self, asked: np.ndarray, rows: _Side, at: slice, start: int) -> None:
        """Queries without ``k`` rows yet."""
        score, k = self._full(asked, rows, at), self.k + 1  # one may be the query itself
        cut = np.full(len(asked), -np.inf)
        if score.shape[1] > k:
            cut = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        q, r = np.nonzero((score >= (cut - 2 * self.unit)[:, None]) & (score > -np.inf))
        self._take(asked[q], r + at.start, rows, start)

    def _bounds(self, asked: np.ndarray, start: int) -> np.ndarray:
        """What a score must reach to enter; a row behind all others must be better than the last one by a step of the rounding."""
        return self.order[asked, -1] + (0.5 if start > self.last else -0.5) * self.unit

    def _screen(self, asked: np.ndarray, rows: _Side, at: np.ndarray, start: int) -> None:
        if not len(asked):
            return
        whole_block = len(asked) == len(self.queries.z)
        asked = self.sorted if whole_block else asked[np.argsort(self.place[asked])]
        bound = self._bounds(asked, start + int(at[0]))
        known, z = rows.m[at][:, self.places], rows.z[at][:, self.places]
        masks, which = _masks(known)
        count = np.bincount(which, minlength=len(masks))
        found_q, found_r = [], []
        square = rows.square[at][:, self.places]
        whole = np.sqrt(square.sum(1))
        norm = np.sqrt(self.masks @ square.T)  # of each row, over the places of each mask of the queries
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            share = norm / whole
            inverse = np.where(share > 0, 1 / share, 0.0)
            unit = np.where(whole[:, None] > 0, z / whole[:, None], 0.0).astype(np.float32)
        odd = ((share > 0) & (share < 1e-12)).any(0) | ~np.isfinite(whole) | ~np.isfinite(norm).all(0)
        shared = self.masks @ masks.T
        valid = (shared >= self.least) & (shared > 0)
        own = self.which[asked]
        inverse = inverse.astype(np.float32)
        single = np.float32 if len(self.places) < 1 << 16 else np.float64
        limit = (bound - 1e-9 - (len(self.places) + 8) * 2.0**-23).astype(single)[:, None]
        limit = np.nextafter(limit, single(-np.inf))
        rare = np.flatnonzero((count[which] < SHARED) | odd)
        cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1))  # queries with the same mask lie together
        together = len(asked) >= TOGETHER * (len(cuts) - 1)
        groups = list(zip(cuts, cuts[1:])) if together else [(0, len(asked))]
        for j in np.flatnonzero(count >= SHARED):
            columns = np.flatnonzero((which == j) & ~odd)
            if not len(columns) or not valid[:, j].any():
                continue
            queries, strange = self._scaled(masks[j])
            scale = np.where(valid[:, j][:, None], inverse[:, columns], np.float32(np.nan))
            for low, high in groups:
                part = unit[columns]
                if together:
                    if not valid[own[low], j]:
                        continue
                    part = part * scale[own[low]][:, None]
                wide = min(len(columns), 512)
                tall = max(1, TILE // wide)
                for b in range(0, len(columns), wide):
                    right, near = part[b : b + wide].T, scale[:, b : b + wide]
                    for a in range(low, high, tall):
                        last = min(a + tall, high)
                        score = (queries[a:last] if whole_block else queries[self.place[asked[a:last]]]) @ right
                        if not together:
                            score *= near[own[a:last]]
                        hit = _places(score >= limit[a:last])
                        if len(hit):
                            q, r = np.divmod(hit, score.shape[1])
                            found_q.append(asked[a + q])
                            found_r.append(at[columns[b + r]])
            if len(strange):
                more = np.intersect1d(strange, asked)
                found_q.append(np.repeat(more, len(columns)))
                found_r.append(np.tile(at[columns], len(more)))
        for b in range(0, len(rare), 512):
            part = at[rare[b : b + 512]]
            for a in range(0, len(asked), 512):
                score = self._full(asked[a : a + 512], rows, part)
                q, r = np.nonzero((score >= bound[a : a + 512, None] - 1e-9) & (score > -np.inf))
                found_q.append(asked[a : a + 512][q])
                found_r.append(part[r])
        if found_q:
            self._take(np.concatenate(found_q), np.concatenate(found_r), rows, start)

    def _scaled(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries over the places of a mask, of norm 1 there, sorted by their own masks; and those that single precision cannot hold."""
        key = mask.tobytes()
        if key not in self.scaled:
            if len(self.scaled) >= SCALED:
                self.scaled.clear()
            z = self.queries.z[:, self.places] * mask
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt((z * z).sum(1))
                strange = np.flatnonzero(~np.isfinite(norm) & self.live)
                made = np.where((norm > 0) & np.isfinite(norm), 1.0, 0.0)[:, None] * z / np.where((norm > 0) & np.isfinite(norm), norm, 1.0)[:, None]
            self.scaled[key] = made[self.sorted].astype(np.float32), strange
        return self.scaled[key]

    def _take(self, q: np.ndarray, r: np.ndarray, rows: _Side, start: int) -> None:
        """Scores of pairs in double precision; those that enter the best do."""
        kept = []
        for a in range(0, len(q), EXACT):
            qa, ra = q[a : a + EXACT], r[a : a + EXACT]
            low, high = min(s.start for s in self.slices), max(s.stop for s in self.slices)
            za, zb, ma, mb = (v[i, low:high] for v, i in ((self.queries.z, qa), (rows.z, ra), (self.queries.m, qa), (rows.m, ra)))
            pairs = ((za, zb), (za * za, mb), (ma, zb * zb), (ma, mb))
            parts = [[np.einsum("ij,ij->i", x[:, s.start - low : s.stop - low], y[:, s.start - low : s.stop - low]) for x, y in pairs] for s in self.slices]
            dot, first, second, shared = (sum(p) for p in zip(*parts))
            with np.errstate(invalid="ignore", over="ignore"):
                score = _cosine(dot, first, second)
                line = np.round(score, self.digits)
            good = np.isfinite(score) & (shared >= self.least) & (shared > 0)
            good &= line >= self.order[qa, -1]
            good = np.flatnonzero(good)
            good = good[(rows.ids[ra[good]] != self.queries.ids[qa[good]]).astype(bool)]
            single = np.stack([_cosine(*(v[good] for v in p[:3])) for p in parts], 1)
            kept.append((qa[good], line[good], start + ra[good], rows.ids[ra[good]], score[good], shared[good].astype(np.int32), single))
        new = [np.concatenate(x) for x in zip(*kept)] if kept else []
        if not new or not len(new[0]):
            return
        changed = np.unique(new[0])
        state = (self.order, self.at, self.ids, self.score, self.shared, self.single)
        q = np.concatenate([new[0], np.repeat(changed, self.k)])
        values = [np.concatenate([x, s[changed].reshape(-1, *s.shape[2:])]) for x, s in zip(new[1:], state)]
        order = np.lexsort((values[1], -values[0], q))
        first = np.flatnonzero(np.diff(q[order], prepend=-1))
        order = order[(first[:, None] + np.arange(self.k)).ravel()]  # every query has k old places at least
        for s, x in zip(state, values):
            s[changed] = x[order].reshape(len(changed), self.k, *s.shape[2:])

    def table(self, kind: pa.DataType, mode: int) -> pa.RecordBatch:
        q, j = np.nonzero(self.order > -np.inf)
        layers = pa.nulls(len(q), pa.list_(pa.float64()))
        if len(self.slices) > 1:
            flat = self.single[q, j].ravel()
            layers = pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * len(self.slices), pa.array(flat, mask=np.isnan(flat)))
        columns = {"mode": pa.array(np.full(len(q), mode, np.int32)), "query_id": pa.array(self.queries.ids[q].tolist(), kind), "identity": pa.array(self.ids[q, j].tolist(), kind)}
        columns |= {"similarity": pa.array(self.score[q, j]), "order": pa.array(self.order[q, j]), "n_shared": pa.array(self.shared[q, j]), "layers": layers}
        return pa.RecordBatch.from_pydict(columns)


def _packed(df: DataFrame, identity: str, name: str, parts: int, salt: int, size: int) -> DataFrame:
    """Rows dealt to ``parts`` parts, in the order of their identities, as tables of ``size`` rows at most: (name_part, name_start, name_dims, name_ids, name_z, name_known)."""
    shape = df.schema[identity].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, start = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal start
            dims, z, known = len(waiting[0].column("vector")[0] or ()), [], []
            for part in waiting:
                values, masks = part.column("vector"), part.column("mask")
                sizes = np.asarray(values.value_lengths().fill_null(-1))
                if (sizes != dims).any() or (np.asarray(masks.value_lengths().fill_null(-1)) != dims).any():
                    raise ValueError(f"vectors and masks need {dims} places")
                x = values.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
                known.append(np.isfinite(x) & ~masks.flatten().fill_null(True).to_numpy(zero_copy_only=False).reshape(-1, dims))
                z.append(np.where(known[-1], x, 0.0))
            ids = pa.chunked_array([p.column("identity") for p in waiting]).combine_chunks()
            columns = [pa.array([waiting[0].column("part")[0].as_py()], pa.int32()), pa.array([start], pa.int64()), pa.array([dims], pa.int32())]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            columns += [pa.array([v.tobytes()], pa.binary()) for v in (np.concatenate(z), np.packbits(np.concatenate(known), axis=1))]
            start += len(ids)
            waiting.clear()
            return pa.RecordBatch.from_arrays(columns, names=[f"{name}_{c}" for c in ("part", "start", "dims", "ids", "z", "known")])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                room = size - sum(w.num_rows for w in waiting)
                waiting.append(batch.slice(at, room))
                at += waiting[-1].num_rows
                if waiting[-1].num_rows == room:
                    yield flush()
        if waiting:
            yield flush()

    part = F.pmod(F.xxhash64(identity, F.lit(salt)), F.lit(parts)).cast("int")
    dealt = df.select(part.alias("part"), F.col(identity).alias("identity"), "vector", "mask").repartitionById(parts, "part").sortWithinPartitions("identity")
    tables = dealt.mapInArrow(pack, f"{name}_part int, {name}_start long, {name}_dims int, {name}_ids array<{shape}>, {name}_z binary, {name}_known binary")
    return tables.repartitionById(parts, f"{name}_part")


def most_similar_by_mode(
    vectors: DataFrame, queries: DataFrame, identity: str, k: int, layers: Mapping[str, tuple[int, int]] | None = None, modes: Sequence[str] = ("integrated",),
    min_coverage: float = 0.5, digits: int = 10, parts: int | None = None,
) -> DataFrame:
    """The ``k`` rows most similar to each query in each of ``modes``: mode and the columns of ``most_similar``. All modes share one visit of the rows."""
    slices = None if layers is None else {n: slice(*s) for n, s in layers.items()}
    for mode in modes:
        if slices is not None and mode != "integrated" and mode not in slices:
            raise ValueError(f"mode must be integrated or one of {', '.join(slices)}")
    spark = vectors.sparkSession
    asked = vectors.join(queries.select(identity).distinct(), identity, "left_semi")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = queries.select(identity).distinct().count()
    blocks = max(1, -(-number // min(QUERIES, max(FEW_QUERIES, -(-number // tasks)))))
    parts = parts or max(1, -(-vectors.count() // PART))
    left, right = _packed(asked, identity, "a", blocks, 0, QUERIES), _packed(vectors, identity, "b", parts, 1, ROWS)
    paired = left.hint("shuffle_replicate_nl").crossJoin(right)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, kind = [], None, None

        def finish() -> Iterator[pa.RecordBatch]:
            for i, b in enumerate(best):
                yield b.table(kind, i)

        for batch in batches:
            row = {n: batch.column(n) for n in batch.schema.names}
            kind = batch.schema.field("a_ids").type.value_type
            for at in range(batch.num_rows):
                here = tuple(row[c][at].as_py() for c in ("a_part", "a_start", "b_part"))
                if here != key:
                    yield from finish()
                    key, asked = here, _Side.packed(row, at, "a")
                    own = slices or {"all": slice(0, asked.z.shape[1])}
                    best = [_Best(asked, k, own, list(own) if mode == "integrated" or slices is None else [mode], min_coverage, digits) for mode in modes]
                rows = _Side.packed(row, at, "b")
                if rows.z.shape[1] != asked.z.shape[1]:
                    raise ValueError(f"vectors and masks need {asked.z.shape[1]} places")
                for b in best:
                    b.meet(rows, row["b_start"][at].as_py())
        yield from finish()

    shape = vectors.schema[identity].dataType.simpleString()
    found = paired.mapInArrow(scan, f"mode int, query_id {shape}, identity {shape}, similarity double, order double, n_shared int, layers array<double>")
    rank = F.row_number().over(Window.partitionBy("mode", "query_id").orderBy(F.desc("order"), "identity"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    pick = lambda values: reduce(lambda out, i: F.when(F.col("mode") == i, values[i]).otherwise(out), range(len(modes)), F.lit(None))
    sims, coverage = [], []
    if slices:
        compared = [list(slices) if mode == "integrated" else [mode] for mode in modes]
        dims = [sum(slices[n].stop - slices[n].start for n in c) for c in compared]
        coverage = [(F.col("n_shared") / pick([F.lit(d) for d in dims])).alias("coverage")]
        one = lambda n, c: F.lit(None).cast("double") if n not in c else F.col("similarity") if len(c) == 1 else F.col("layers")[c.index(n)]
        sims = [pick([one(n, c) for c in compared]).alias(f"sim_{n}") for n in slices]
    name = pick([F.lit(mode) for mode in modes]).alias("mode")
    return best.select(name, "query_id", F.col("identity").alias(identity), "similarity", "n_shared", *coverage, *sims, "rank")


def most_similar(
    vectors: DataFrame, queries: DataFrame, identity: str, k: int, layers: Mapping[str, tuple[int, int]] | None = None, mode: str = "integrated",
    min_coverage: float = 0.5, digits: int = 10, parts: int | None = None,
) -> DataFrame:
    """The ``k`` rows most similar to each query: query_id, identity, similarity, n_shared, coverage, similarities by layer, rank.

    ``vectors`` has ``identity`` (one row each), ``vector`` and ``mask`` (true: missing); null and non-finite places are missing too. ``layers`` names slices
    (first place, place after the last) of the vector; ``mode`` is one of them, or "integrated" for all. A pair counts if it shares ``min_coverage`` of the
    compared places and neither norm over them is 0. Scores are ranked after rounding to ``digits``, ties by identity.
    """
    return most_similar_by_mode(vectors, queries, identity, k, layers, [mode], min_coverage, digits, parts).drop("mode")


def join_layers(layer_vectors: DataFrame, identity: str, layers: Mapping[str, int]) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """One vector per row out of a long table (identity, layer, z, missing), and the slice of each layer; ``layers`` gives their sizes. Absent layers are missing places."""
    pick = lambda c, n: F.max(F.when(F.col("layer") == n, F.col(c)))
    wide = layer_vectors.groupBy(identity).agg(*[pick(c, n).alias(f"_{c}_{n}") for n in layers for c in ("z", "missing")])
    empty = {"z": "double", "missing": "boolean"}
    filled = {c: F.concat(*[F.coalesce(F.col(f"_{c}_{n}").cast(f"array<{kind}>"), F.array_repeat(F.lit(0.0 if c == "z" else True).cast(kind), size)) for n, size in layers.items()])
              for c, kind in empty.items()}
    starts, at = {}, 0
    for n, size in layers.items():
        starts[n] = (at, at + size)
        at += size
    return wide.select(identity, filled["z"].alias("vector"), filled["missing"].alias("mask")), starts

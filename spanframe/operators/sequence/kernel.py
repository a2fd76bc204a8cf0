"""Numpy over the bytes of chunks: position-based values without a row per base.

``scan`` hands a function blocks of chunk pieces as one array of base codes and gets back rows. Pieces carry their halo, so nothing is shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bases that a function gets at once, about.
BLOCK_BASES = 1 << 16
#: Bases of a group whose k-mers go to one bucket; larger groups are dealt over several.
BUCKET_BASES = 1 << 22
_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = range(4)


@dataclass
class Pieces:
    """Pieces of a block: bytes and codes (0-3, 4 unknown) end to end, and for each piece its place in them and in its sequence."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    n: np.ndarray
    core_start: np.ndarray
    core_end: np.ndarray
    piece_start: np.ndarray

    def __post_init__(self) -> None:
        self.code = _CODE[self.data]
        self.piece = np.repeat(np.arange(len(self.begin)), self.end - self.begin)
        self.at = np.arange(len(self.data))
        self.i = self.at + (self.piece_start - self.begin)[self.piece]

    def core(self, reach: int) -> np.ndarray:
        """Places of the core from which ``reach`` bases lie inside the sequence."""
        return self.grid(1, reach)

    def grid(self, step: int, reach: int) -> np.ndarray:
        """Those of them whose number in the sequence is a multiple of ``step``."""
        first = -(-np.maximum(self.core_start, self.piece_start) // step) * step
        last = np.minimum(np.minimum(self.core_end - 1, self.n - reach), self.piece_start + self.end - self.begin - 1)
        count = np.maximum((last - first) // step + 1, 0)
        total = np.cumsum(count)
        number = int(total[-1]) if len(total) else 0
        return np.repeat(self.begin + first - self.piece_start - step * (total - count), count) + step * np.arange(number)

    def ahead(self, values: np.ndarray, fill) -> np.ndarray:
        """Values with room behind the end, for windows that start at places ``core`` excludes."""
        return np.concatenate([values, np.full(64, fill, values.dtype)])


PLACES = ("n", "core_start", "core_end", "piece_start")


def _read(part: pa.RecordBatch) -> Pieces:
    texts = part.column("piece").cast(pa.binary())
    lengths = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    return Pieces(data, ends - lengths, ends, *(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in PLACES))


def scan(pieces: DataFrame, fn: Callable[[Pieces], tuple[np.ndarray, dict]], schema: str, *keep: str) -> DataFrame:
    """(seq_id, *keep, columns of ``schema``): ``fn`` returns the piece of each row and the columns."""
    names = ["seq_id", *keep]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (pieces.schema[n] for n in names))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column("piece")).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // BLOCK_BASES, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                part = batch.slice(a, b - a)
                which, made = fn(_read(part))
                if len(which):
                    taken = part.select(names).take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(v) for v in made.values())], names=[*names, *made])

    return pieces.select(*dict.fromkeys([*names, *PLACES, "piece"])).mapInArrow(rows, f"{head}, {schema}")


class RunningSteps:
    """Known steps of the core with their code, and the running sum of a whole-number table over the sequence's steps so far.

    Pieces come in the order ``chunks(..., spread=False)`` makes them, those of a sequence one behind the other; the sum carries over, also into a task's next block.
    """

    def __init__(self, table: list[int]):
        self.table, self.carry = np.array([*table, 0], np.int64), 0

    def __call__(self, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at, code = p.core(2), p.ahead(p.code, 4).astype(np.int64)
        step = np.where((code[at] < 4) & (code[at + 1] < 4), 4 * code[at] + code[at + 1], 16)
        value, which = self.table[step], p.piece[at]
        total = np.concatenate([[0], np.cumsum(value)])
        cuts = np.searchsorted(which, np.arange(len(p.begin) + 1))
        first = p.core_start == 0
        base = np.where(first, total[cuts[:-1]], 0)  # what lies before the sequence's first piece in this block
        last = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
        offset = np.where(last >= 0, -base[np.maximum(last, 0)], self.carry)
        run = total[1:] + offset[which]
        if len(offset):
            self.carry = int(total[-1] + offset[-1])
        known = step < 16
        return which[known], p.i[at[known]], step[known], run[known]


def step_counts(df: DataFrame, sequence: str, names: list[str]) -> DataFrame:
    """``df`` with the number of each of 16 steps of a text of A, C, G, T and N, as if its N were not there; nulls for a null text. Long texts are counted by parts."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def counts(texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 16), np.int64)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])
        code = _CODE[np.frombuffer(b"".join(texts), np.uint8)]
        known = code < 4
        if not known.all():
            code, row = code[known], row[known]
        step = (code[:-1] << 2 | code[1:]).astype(np.int32) + 16 * row[:-1]
        inside = row[1:] == row[:-1]
        out += np.bincount(step[inside], minlength=16 * len(texts)).reshape(-1, 16)
        return out

    def long(text: bytes) -> np.ndarray:
        out, last = np.zeros(16, np.int64), b""
        for a in range(0, len(text), BLOCK_BASES):
            part = last + text[a : a + BLOCK_BASES].replace(b"N", b"")
            out += counts([part])[0]
            last = part[-1:]
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(sequence).cast(pa.binary()).to_pylist()]
            out, group, size = [], [], 0
            for text in [*texts, None]:
                if group and (text is None or size + len(text) > BLOCK_BASES):
                    out.append(counts(group) if size <= BLOCK_BASES else long(group[0])[None])
                    group, size = [], 0
                if text is not None:
                    group.append(text)
                    size += len(text)
            found = np.concatenate(out) if out else np.zeros((0, 16), np.int64)
            null = batch.column(sequence).is_null().to_numpy(zero_copy_only=False)
            made = [pa.array(found[:, j].astype(np.int32), mask=null) for j in range(16)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return df.mapInArrow(rows, f"{shape}, " + ", ".join(f"{n} int" for n in names))


def pwm_hits(rows: list[list[float]], reverse: list[list[float]], threshold: float):
    length = len(rows[0])
    tables = [np.vstack([np.array(r, float), np.full(length, np.nan)]) for r in (rows, reverse)]

    def fn(p: Pieces):
        at, code = p.core(length), p.ahead(p.code, 4)
        which, start, strand, score = [], [], [], []
        for sign, table in zip("+-", tables):
            total = table[code[at], 0]
            for k in range(1, length):
                total = total + table[code[at + k], k]
            hit = np.flatnonzero(total >= threshold)
            which.append(p.piece[at[hit]])
            start.append(p.i[at[hit]])
            strand += [sign] * len(hit)
            score.append(total[hit])
        first = np.concatenate(start)
        return np.concatenate(which), {"start": first, "end": first + length, "strand": pa.array(strand, pa.string()), "score": np.concatenate(score)}

    return fn


def curvature_steps(p: Pieces, roll: np.ndarray, tilt: np.ndarray, twist: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the core's steps and their curvature in degrees; the tables have 16 steps and a last entry of 0 for unknown ones."""
    code = p.ahead(p.code, 4)[: len(p.code) + 1].astype(np.int64)
    step = np.where((code[:-1] < 4) & (code[1:] < 4), 4 * code[:-1] + code[1:], 16)
    inside = p.at < (p.end - 1)[p.piece]
    step[~inside] = 16
    angle = np.cumsum(twist[step])
    c, s = np.cos(angle), np.sin(angle)
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (roll[step] * c - tilt[step] * s, roll[step] * s + tilt[step] * c)]
    at = np.flatnonzero(inside & (p.i >= p.core_start[p.piece]) & (p.i < p.core_end[p.piece]))
    low, high = np.maximum(at - half, p.begin[p.piece[at]]), np.minimum(at + half, p.end[p.piece[at]] - 2)
    x, y = (v[high + 1] - v[low] for v in sums)
    return at, np.degrees(np.sqrt(x * x + y * y) / (high - low + 1))


def window_sums(p: Pieces, roll: np.ndarray, tilt: np.ndarray, twist: np.ndarray) -> dict[str, np.ndarray]:
    """For each piece, a window of its own: steps, known steps, vector sums of the bend, and sums of the AT-step indicator for its 10.5-bp power; the tables are in radians and have an entry of 0 for unknown steps."""
    count = len(p.begin)
    at = np.flatnonzero(p.at < (p.end - 1)[p.piece])
    code, which = p.code.astype(np.int64), p.piece[at]
    step = np.where((code[at] < 4) & (code[at + 1] < 4), 4 * code[at] + code[at + 1], 16)
    cuts = np.searchsorted(which, np.arange(count))
    total = np.concatenate([[0.0], np.cumsum(twist[step])])
    angle = total[1:] - total[cuts][which]
    m = np.maximum(p.end - p.begin - 1, 0)
    i, own = at - p.begin[which], np.maximum(m, 1)
    low = np.floor(m / 10.5)
    near = np.where(np.abs(low / own - 1 / 10.5) <= np.abs((low + 1) / own - 1 / 10.5), low, low + 1)
    x = np.isin(step, (0, 3, 12, 15)).astype(float)
    wave = 2 * np.pi * near[which] * i / own[which]
    c, s = np.cos(angle), np.sin(angle)
    sums = {"k": step < 16, "dx": roll[step] * c - tilt[step] * s, "dy": roll[step] * s + tilt[step] * c, "sx": x, "re": x * np.cos(wave), "im": x * np.sin(wave), "alt": x * (1 - 2 * (i % 2))}
    return {"m": m} | {n: np.bincount(which, v, count) for n, v in sums.items()}


def island_runs(width: int, least_gc: float, least_ratio: float):
    """Runs of consecutive window starts that qualify, as intervals that cover their windows."""

    def fn(p: Pieces):
        at = p.core(width)
        c, g = p.code == 1, p.code == 2
        pair = c & np.append(g[1:], False)
        n_c, n_g, n_p = (np.concatenate([[0], np.cumsum(v)]) for v in (c, g, pair))
        cc, gg, cg = n_c[at + width] - n_c[at], n_g[at + width] - n_g[at], n_p[at + width - 1] - n_p[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            good = at[((cc + gg) / width >= least_gc) & (cc * gg > 0) & (cg / (cc * gg / width) >= least_ratio)]
        if not len(good):
            return good, {"start_pos": good, "end_pos": good}
        cut = np.flatnonzero((np.diff(good) > 1) | (np.diff(p.piece[good]) > 0))
        first, last = good[np.append(0, cut + 1)], good[np.append(cut, len(good) - 1)]
        return p.piece[first], {"start_pos": p.i[first], "end_pos": p.i[last] + width}

    return fn


def cpg_places(reach: int):
    """Places of CG, with the share of G and C among ``reach`` bases on both sides: two lookups in prefix counts."""

    def fn(p: Pieces):
        at = p.core(2)
        at = at[(p.code[at] == 1) & (p.code[at + 1] == 2)]
        total = np.concatenate([[0], np.cumsum((p.code == 1) | (p.code == 2))])
        piece = p.piece[at]
        low, high = np.maximum(at - reach, p.begin[piece]), np.minimum(at + reach, p.end[piece])
        return piece, {"pos": p.i[at], "gc_content": (total[high] - total[low]) / (high - low)}

    return fn


def skew_and_hairpins(width: int, step: int, stem: int, reach: int):
    """Per whole piece: mean of |G - C| / (G + C) times the share of G over windows of ``width`` every ``step`` bases (those with G or C), and the
    places whose ``stem`` bases have their reverse complement inside the next ``reach`` bases."""

    def fn(p: Pieces):
        count = len(p.begin)
        g, c = (np.concatenate([[0], np.cumsum(p.code == b)]) for b in (2, 1))
        at = np.flatnonzero((p.i % step == 0) & (p.i + width <= p.n[p.piece]))
        gg, cc = g[at + width] - g[at], c[at + width] - c[at]
        some = np.flatnonzero(gg + cc > 0)
        at, gg, cc = at[some], gg[some], cc[some]
        total = np.bincount(p.piece[at], np.abs((gg - cc) / (gg + cc)) * (gg / width), count)
        number = np.bincount(p.piece[at], minlength=count)
        code = p.ahead(p.code, 4).astype(np.int64)
        forward, back = np.zeros(len(p.code), np.int64), np.zeros(len(p.code), np.int64)
        for k in range(stem):
            own = code[k : k + len(p.code)]
            forward = forward * 5 + own
            back = back + np.where(own < 4, 3 - own, 4) * 5**k
        found, left = np.zeros(len(p.code), bool), p.n[p.piece] - p.i
        for d in range(stem, reach + 1):
            hit = np.zeros(len(p.code), bool)
            hit[: len(p.code) - d] = forward[d:] == back[: len(p.code) - d]
            found |= hit & (d + stem <= left)
        found &= left >= 2 * stem + 2
        pairs = np.bincount(p.piece[found], minlength=count)
        return np.arange(count), {"rloop": total / np.maximum(number, 1), "hairpins": pairs.astype(np.int64)}

    return fn


def _spelled_words(base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ``k`` bases from each place on and of their reverse complement, two bits a base, out of words of 1, 2, 4 ... bases; only places with ``k`` bases before the end are right."""
    n = len(base)
    forward, back, length = np.zeros(n, base.dtype), np.zeros(n, base.dtype), 0
    word, other, size = base, 3 - base, 1
    while size <= k:
        if k & size:
            forward[: n - length] = forward[: n - length] << (2 * size) | word[length:]
            back[: n - length] |= other[length:] << (2 * length)
            length += size
        if 2 * size <= k:
            word, other = (np.concatenate([v, np.zeros(size, base.dtype)]) for v in (word[:-size] << (2 * size) | word[size:], other[:-size] | other[size:] << (2 * size)))
        size *= 2
    return forward, back


def _again(code: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places whose code may occur again in its group: counts by hash rule out most of the others, so that few are sorted."""
    bits = max(10, len(code).bit_length() + 2)
    slot = (code ^ (group * 0x85EBCA6B)) * np.int64(0x1E3779B97F4A7C15) >> (63 - bits) & ((1 << bits) - 1)
    return np.flatnonzero(np.bincount(slot, minlength=1)[slot] > 1) if len(slot) else slot


def canonical_kmers(k: int):
    """Places of k-mers of known bases: code of the smaller strand (two bits a base) and whether it is the forward one.

    Where a piece is a whole sequence, k-mers that occur once there on both strands together are left out: they repeat nowhere.
    """

    def fn(p: Pieces):
        at, code = p.core(k), p.ahead(p.code, 4)
        if (p.code == 4).any():
            unknown = np.concatenate([[0], np.cumsum(code == 4)])
            at = at[unknown[at + k] == unknown[at]]
        base = (code & 3).astype(np.int32 if 2 * k < 32 else np.int64)
        forward, back = (v[at].astype(np.int64) for v in _spelled_words(base, k))
        canon, piece = np.minimum(forward, back), p.piece[at]
        whole = (p.core_start == 0) & (p.core_end >= p.n)
        some = _again(canon, piece)
        own, place = canon[some], piece[some]
        shift = int(place.max(initial=0)).bit_length()
        order = np.argsort(own << shift | place) if 2 * k + shift < 64 else np.lexsort((own, place))
        same = (own[order][1:] == own[order][:-1]) & (place[order][1:] == place[order][:-1])
        often = np.zeros(len(at), bool)
        often[some[order]] = (np.append(same, False) | np.append(False, same))[: len(order)]
        keep = np.flatnonzero(often | ~whole[piece])
        return piece[keep], {"canon": canon[keep], "fwd": (forward <= back)[keep], "i": p.i[at[keep]]}

    return fn


def forward_kmers(k: int):
    """Places of k-mers of known bases, the first of each in a piece: codes of two bits a base."""

    def fn(p: Pieces):
        at, code = p.core(k), p.ahead(p.code, 4).astype(np.int64)
        unknown = np.concatenate([[0], np.cumsum(code == 4)])
        at = at[unknown[at + k] == unknown[at]]
        forward = np.zeros(len(at), np.int64)
        for j in range(k):
            forward = forward << 2 | code[at + j]
        order = np.lexsort((p.i[at], forward, p.piece[at])) if 2 * k > 40 else np.argsort(p.piece[at] << (2 * k) | forward, kind="stable")
        own, piece = forward[order], p.piece[at[order]]
        first = np.append(True, (own[1:] != own[:-1]) | (piece[1:] != piece[:-1]))[: len(own)]
        keep = order[first]
        return p.piece[at[keep]], {"kmer": forward[keep], "i": p.i[at[keep]]}

    return fn


def by_kmer(pieces: DataFrame, key: str, total: str, k: int, kmers, fn, schema: str, *keep: str) -> DataFrame:
    """(key, columns of ``schema``): ``fn(group, keep, kmers)`` sees all k-mers of a bucket of some groups together.

    ``total`` holds a group's bases. Up to BUCKET_BASES, its pieces are shuffled as text and cut into k-mers where they arrive; beyond, k-mers are cut
    first and each goes to the bucket its code names, so that no task holds a group whole. ``fn`` returns the group of each row and the columns.
    """
    names = [key, *keep]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (pieces.schema[n] for n in names))
    cols = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in PLACES)
    columns = [*names, *PLACES, "piece", "bucket", "packed"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = 1 + batch.column(total).to_numpy(zero_copy_only=False).astype(np.int64) // BUCKET_BASES
            small = np.flatnonzero(number == 1)
            if len(small):
                part = batch.take(pa.array(small))
                fixed = [part.column("piece").cast(pa.binary()), pa.array(np.zeros(len(small), np.int32)), pa.nulls(len(small), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns[:-3]), *fixed], names=columns)
            large = np.flatnonzero(number > 1)
            for a in range(0, len(large), 32):
                part = batch.take(pa.array(large[a : a + 32]))
                which, made = kmers(_read(part))
                values = np.stack([np.asarray(v, np.int64) for v in made.values()], 1)
                bucket = (values[:, 0] * 0x9E3779B1 >> 7) % number[large[a : a + 32]][which]
                order = np.lexsort((bucket, which))
                which, bucket, values = which[order], bucket[order], values[order]
                first = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (bucket[1:] != bucket[:-1]))[: len(which)])
                packed = [values[x:y].tobytes() for x, y in zip(first, [*first[1:], len(which)])]
                taken = part.take(pa.array(which[first]))
                fixed = [pa.array([b""] * len(first), pa.binary()), pa.array(bucket[first].astype(np.int32)), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in columns[:-3]), *fixed], names=columns)

    def whole(table: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
        batch = table.combine_chunks().to_batches()[0]
        text = pa.compute.is_null(batch.column("packed")).to_numpy(zero_copy_only=False)
        rows, parts = [], []
        at = np.flatnonzero(text)
        if len(at):
            which, made = kmers(_read(batch.take(pa.array(at))))
            rows.append(at[which])
            parts.append([np.asarray(v, np.int64) for v in made.values()])
        for r in np.flatnonzero(~text):
            values = np.frombuffer(batch.column("packed")[int(r)].as_py(), np.int64).reshape(-1, values_wide)
            rows.append(np.full(len(values), r))
            parts.append(list(values.T))
        row = np.concatenate(rows)
        which, made = fn(group[row], {c: batch.column(c).take(pa.array(row)) for c in keep}, [np.concatenate(v) for v in zip(*parts)])
        if not len(which):
            return None
        first = np.flatnonzero(np.diff(group, prepend=-1))
        taken = batch.column(key).take(pa.array(first[which]))
        return pa.RecordBatch.from_arrays([taken, *(pa.array(v) for v in made.values())], names=[key, *made])

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, about two times BLOCK_BASES at a time; the rows come in order of their groups."""
        left = None
        for batch in itertools.chain(batches, [None]):
            table = left if batch is None else pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            new = np.zeros(table.num_rows, bool)
            for c in (key, "bucket"):
                v = table.column(c).combine_chunks()
                new[1:] |= pa.compute.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            end = table.num_rows if batch is None else int(starts[-1]) if len(starts) else 0
            left = table.slice(end)
            group = np.cumsum(new)
            size = sum(pa.compute.fill_null(pa.compute.binary_length(table.column(c)), 0).to_numpy() for c in ("piece", "packed"))
            here = np.append(0, starts[starts < end]) if end else starts[:0]
            weight = np.cumsum(size)[here] // (2 * BLOCK_BASES)
            cuts = here[np.flatnonzero(np.diff(weight, prepend=-1))]
            for a, b in zip(cuts, [*cuts[1:], end]):
                out = whole(table.slice(a, b - a), group[a:b] - group[a])
                if out is not None:
                    yield out

    values_wide = len(kmers(Pieces(np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 6))[1])
    dealt = pieces.select(*dict.fromkeys([*names, *PLACES, "piece", total])).mapInArrow(deal, f"{head}, {cols}, piece binary, bucket int, packed binary")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [pieces.schema[key]])
    return dealt.repartition(key, "bucket").sortWithinPartitions(key, "bucket").mapInArrow(collected, f"{own}, {schema}")


def repeat_places(group: np.ndarray, _: dict, values: list[np.ndarray]):
    """Of each group's canonical k-mers that occur again: first places on both strands, the next ones, and the closest before the other strand's next."""
    canon, fwd, i = values
    some = _again(canon, group)
    canon, fwd, i, group = canon[some], fwd[some], i[some], group[some]
    order = np.lexsort((canon, group))
    g, c = group[order], canon[order]
    same = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
    rows = order[np.append(same, False)[: len(order)] | np.append(False, same)[: len(order)]]
    g, c, f, i = group[rows], canon[rows], fwd[rows] > 0, i[rows]
    first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))[: len(rows)])
    none = np.iinfo(np.int64).max
    if not len(rows):
        return first, {n: first for n in ("canon", "f1", "r1", "f2", "r2", "r_after", "f_after", "f_before", "r_before")}
    each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
    least = lambda mask: np.minimum.reduceat(np.where(mask, i, none), first)
    most = lambda mask: np.maximum.reduceat(np.where(mask, i, -1), first)
    f1, r1 = least(f), least(~f)
    after_f, after_r = i > f1[each], i > r1[each]
    out = {"f1": f1, "r1": r1, "f2": least(f & after_f), "r2": least(~f & after_r), "r_after": least(~f & after_f), "f_after": least(f & after_r)}
    for name, mask, bound in (("f_before", f, out["r_after"]), ("r_before", ~f, out["f_after"])):
        out[name] = most(mask & (i < bound[each]) & (bound[each] < none))
    return g[first], {"canon": c[first]} | {n: pa.array(v, mask=(v == none) | (v < 0)) for n, v in out.items()}


def shared_places(group: np.ndarray, keep: dict, values: list[np.ndarray]):
    """K-mers that several parts of a group have: each pair of such parts with its first places."""
    part, (kmer, i) = keep["part_no"].to_numpy(zero_copy_only=False), values
    order = np.lexsort((kmer, group))
    g, c = group[order], kmer[order]
    same = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
    rows = order[np.append(same, False)[: len(order)] | np.append(False, same)[: len(order)]]
    if not len(rows):
        return rows, {n: rows for n in ("kmer", "part_a", "position_a", "part_b", "position_b")}
    rows = rows[np.lexsort((i[rows], part[rows], kmer[rows], group[rows]))]
    g, c, p, i = group[rows], kmer[rows], part[rows], i[rows]
    other = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    keep_ = np.append(True, other | (p[1:] != p[:-1]))[: len(rows)]
    new = np.append(True, other)[: len(rows)][keep_]
    g, c, p, i = g[keep_], c[keep_], p[keep_], i[keep_]
    first = np.flatnonzero(new)
    last = np.repeat(np.append(first[1:], len(g)), np.diff(np.append(first, len(g))))
    more = last - 1 - np.arange(len(g))
    a = np.repeat(np.arange(len(g)), more)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(more) - more, more)
    return g[a], {"kmer": c[a], "part_a": p[a], "position_a": i[a] + 1, "part_b": p[b], "position_b": i[b] + 1}


def gc_counts(window: int):
    """Per window of ``window`` bases from a sequence's start on: its end, G and C, known bases."""

    def fn(p: Pieces):
        at = p.grid(window, 1)
        end = np.minimum(at + window, p.end[p.piece[at]])
        gc, known = (np.concatenate([[0], np.cumsum(v)]) for v in ((p.code == 1) | (p.code == 2), p.data != ord("N")))
        return p.piece[at], {"start": (p.i[at] + 1).astype(np.int32), "end": (p.i[at] + end - at).astype(np.int32), "_gc": gc[end] - gc[at], "_known": known[end] - known[at]}

    return fn


def step_sums(window: int, values: list[int]):
    """Per run of ``window`` steps from a sequence's start on: sum of a whole-number property of 16 steps, and known steps."""
    table = np.array([*values, 0], np.int64)

    def fn(p: Pieces):
        code = p.ahead(p.code, 4)[: len(p.code) + 1]
        known = (code[:-1] < 4) & (code[1:] < 4)
        step = np.where(known, 4 * code[:-1] + code[1:], 16)
        at = p.grid(window, 2)
        end = np.minimum(at + window, p.end[p.piece[at]] - 1)
        total, number = (np.concatenate([[0], np.cumsum(v)]) for v in (table[step], known))
        return p.piece[at], {"w": (p.i[at] // window).astype(np.int32), "_sum": total[end] - total[at], "_steps": number[end] - number[at]}

    return fn


def site_places(sites: dict[str, str]):
    """Places of each site, overlapping ones too: its number in the order of ``sites``."""
    wanted = [np.array(_CODE[list(s.encode())], np.uint8) for s in sites.values()]

    def fn(p: Pieces):
        code, which, number, place = p.ahead(p.code, 4), [], [], []
        for k, site in enumerate(wanted):
            at = p.core(len(site))
            for j, base in enumerate(site):
                at = at[code[at + j] == base]
            which.append(p.piece[at])
            number.append(np.full(len(at), k, np.int32))
            place.append(p.i[at])
        return np.concatenate(which), {"site": np.concatenate(number), "i": np.concatenate(place)}

    return fn


def context_sums(half: int, stability: list[int], flexibility: list[int], scale: int):
    """Per piece: steps, those with a known step within ``half`` steps, and over them sum and maximum of the bubble propensity and sum of the mean flexibility."""
    tables = [np.array([*t, 0], np.int64) for t in (stability, flexibility)]

    def fn(p: Pieces):
        code = p.ahead(p.code, 4)[: len(p.code) + 1].astype(np.int64)
        known = (code[:-1] < 4) & (code[1:] < 4)
        step = np.where(known, 4 * code[:-1] + code[1:], 16)
        at = p.core(2)
        low, high = np.maximum(at - half, p.begin[p.piece[at]]), np.minimum(at + half + 1, p.end[p.piece[at]] - 1)
        number, dg, trx = (t[high] - t[low] for t in (np.concatenate([[0], np.cumsum(v)]) for v in (known, *(t[step] for t in tables))))
        some = number > 0
        which, first, n = np.unique(p.piece[at], return_index=True, return_counts=True)
        if not len(at):
            return which, {c: n for c in ("n", "known", "bubble", "most", "bend")}
        count = np.maximum(number, 1)
        bubble = np.where(some, 1 / (1 + np.exp(-4.0 * (dg / scale / count + 1.2))), 0.0)
        most = np.maximum.reduceat(bubble, first)
        own = np.add.reduceat(some.astype(np.int64), first)
        bend = np.where(some, trx / scale / count, 0.0)
        return which, {"n": n, "known": own, "bubble": np.add.reduceat(bubble, first), "most": pa.array(most, mask=own == 0), "bend": np.add.reduceat(bend, first)}

    return fn


def stems(stem: int, least: int, most: int):
    """Places of ``stem`` known bases whose reverse complement first follows after a loop of ``least`` to ``most`` bases."""

    def fn(p: Pieces):
        at, code = p.core(2 * stem + 2), p.ahead(p.code, 4).astype(np.int64)
        forward, back = np.zeros(len(p.code), np.int64), np.zeros(len(p.code), np.int64)
        bad = np.zeros(len(p.code), bool)
        for k in range(stem):
            own = code[k : k + len(p.code)]
            bad |= own > 3
            forward = forward * 5 + own
            back = back + np.where(own < 4, 3 - own, 4) * 5**k
        at = at[~bad[at]]
        left, loop = (p.n[p.piece] - p.i)[at], np.full(len(at), -1)
        forward = np.append(forward, np.full(stem + most + 1, -1))
        for d in range(most, -1, -1):
            loop[(forward[at + stem + d] == back[at]) & (d + 2 * stem <= left)] = d
        hit = loop >= least
        at, loop = at[hit], loop[hit]
        text = p.data[at[:, None] + np.arange(stem)] if len(at) else np.zeros((0, stem), np.uint8)
        words = np.ascontiguousarray(text).view(f"S{stem}").ravel().astype(f"U{stem}")
        return p.piece[at], {"start": p.i[at].astype(np.int32), "end": (p.i[at] + 2 * stem + loop).astype(np.int32), "loop_length": loop.astype(np.int32), "stem_5prime": pa.array(words, pa.string())}

    return fn

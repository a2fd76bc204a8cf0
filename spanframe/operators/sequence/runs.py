"""Runs and patterns over chunks: numpy inside a chunk, chunk summaries across seams.

A link is a fact about a base and the ones just before it (same base, other class, same as two before). Links of a chunk's own bases need only
a halo of two bases on the left, and a run is a stretch of links, so the runs of neighbouring chunks continue each other exactly where their
stretches touch. Stretches inside a chunk are complete; only those that touch its ends, two a chunk at most, meet in a window over a sequence's chunks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.operators.sequence import kernel
from spanframe.operators.sequence.steps import CHUNK, chunks

#: Bases before a base that a link of each kind looks at.
LAG = {"same": 1, "alternating": 1, "period2": 2}
_PURINE = np.array([1, 0, 1, 0, 2], np.uint8)
_Z = np.array([round(K.Z_FORM[d] * K.STEP_SCALE) for d in K.DINUCLEOTIDES] + [0], np.int64)
# Longest loop of a quadruplex, shortest run of G in it, and the pattern itself.
LOOP, BLOCK = 7, 3
G4 = r"G{3,}\w{1,7}G{3,}\w{1,7}G{3,}\w{1,7}G{3,}"
SHORTEST_G4 = 4 * BLOCK + 3


def _pieces(df: DataFrame, left: int, right: int, size: int) -> DataFrame:
    return chunks(df.select(*[c for c in ("seq_id", "chunk", "start_pos", "sequence") if c in df.columns]), left, right, size, spread=False)


def _links(p: kernel.Pieces, kind: str) -> np.ndarray:
    code, lag = p.code, LAG[kind]
    link = np.zeros(len(code), bool)
    if kind == "alternating":
        own = _PURINE[code]
        link[1:] = (own[1:] != own[:-1]) & (own[1:] < 2) & (own[:-1] < 2)
    elif len(code) > lag:
        link[lag:] = (code[lag:] == code[:-lag]) & (code[lag:] < 4)
        if lag == 2:
            link[2:] &= code[1:-1] < 4
    for k in range(lag):
        link[np.minimum(p.begin + k, len(code) - 1)] = False
    return link & (p.i >= p.core_start[p.piece]) & (p.i < p.core_end[p.piece])


def _stretches(mark: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each stretch of True inside one piece, and the place after its last."""
    edge = piece[1:] != piece[:-1]
    first, last = mark.copy(), mark.copy()
    first[1:] &= ~mark[:-1] | edge
    last[:-1] &= ~mark[1:] | edge
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def link_stretches(kind: str, least: int):
    """Kernel: stretches of links, lo to hi in the sequence, with the codes of the run's first two bases and the Z penalties of its steps.

    Stretches that touch the chunk's ends are open; the others are given where their run has ``least`` bases.
    """
    lag = LAG[kind]

    def fn(p: kernel.Pieces):
        a, b = _stretches(_links(p, kind), p.piece)
        piece, lo = p.piece[a], p.i[a]
        hi = lo + b - a
        open_ = ((lo == p.core_start[piece]) & (lo > 0)) | ((hi == p.core_end[piece]) & (hi < p.n[piece]))
        keep = np.flatnonzero(open_ | (b - a + lag >= least))
        a, b, piece = a[keep], b[keep], piece[keep]
        made = {"lo": lo[keep], "hi": hi[keep], "open": open_[keep], "one": p.code[a - lag].astype(np.int64), "two": p.code[a - lag + 1].astype(np.int64)}
        if kind == "alternating":
            code = p.code.astype(np.int64)
            step = np.zeros(len(code) + 1, np.int64)
            step[2:] = np.where((code[1:] < 4) & (code[:-1] < 4), _Z[np.minimum(4 * code[:-1] + code[1:], 16)], 0)
            total = np.cumsum(step)
            made |= {"z": total[b] - total[a], "z_last": step[b]}
        return piece, made

    return fn


def _joined(open_: DataFrame, gap: int, more: dict[str, Column]) -> DataFrame:
    """Open stretches of neighbouring chunks, ``gap`` apart at most, as one: (seq_id, lo, hi, *more)."""
    order = Window.partitionBy("seq_id").orderBy("lo")
    starts = F.coalesce(F.col("lo") - F.lag("hi").over(order) > gap, F.lit(True)).cast("int")
    numbered = open_.withColumn("_new", starts).withColumn("_group", F.sum("_new").over(order))
    return numbered.groupBy("seq_id", "_group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[c.alias(n) for n, c in more.items()]).drop("_group")


def base_runs(df: DataFrame, kind: str, least: int, size: int = CHUNK, pieces: DataFrame | None = None) -> DataFrame:
    """Maximal runs of a kind with ``least`` bases at least: (seq_id, start, end, one, two[, z, z_last]), 0-based half-open; one and two are the codes of the first bases."""
    extra = {"z": F.sum("z"), "z_last": F.max_by("z_last", "hi")} if kind == "alternating" else {}
    schema = "lo long, hi long, open boolean, one long, two long" + "".join(f", {c} long" for c in extra)
    found = kernel.scan(_pieces(df, 2, 0, size) if pieces is None else pieces, link_stretches(kind, least), schema)
    seams = _joined(found.where("open"), 0, {"one": F.min_by("one", "lo"), "two": F.min_by("two", "lo"), **extra})
    columns = ["seq_id", "lo", "hi", "one", "two", *extra]
    runs = found.where("NOT open").select(*columns).unionByName(seams.select(*columns))
    lag = LAG[kind]
    return runs.where(F.col("hi") - F.col("lo") + lag >= least).select("seq_id", (F.col("lo") - lag).alias("start"), F.col("hi").alias("end"), "one", "two", *extra)


def base_of(code: Column) -> Column:
    return F.substring(F.lit("ACGT"), (code + 1).cast("int"), F.lit(1))


def tandem_stretches(least: int):
    """Kernel: runs of repeated base pairs, from left to right without overlap.

    Two runs of period two share one base at most. Where a run's whole pairs take that base, the next run begins one base later, and that flips with every
    run of even length; so a run's shift is the parity of the even runs before it in a chain of overlapping runs. Chains that touch the chunk's ends are open: their
    stretches are given as they are.
    """

    def fn(p: kernel.Pieces):
        a, b = _stretches(_links(p, "period2"), p.piece)
        piece, lo = p.piece[a], p.i[a]
        hi = lo + b - a
        edge = ((lo <= p.core_start[piece] + 1) & (p.core_start[piece] > 0)) | ((hi >= p.core_end[piece] - 1) & (p.core_end[piece] < p.n[piece]))
        keep = np.flatnonzero(edge | (b - a + 2 >= least))
        a, b, piece, lo, hi, edge = (x[keep] for x in (a, b, piece, lo, hi, edge))
        fresh = np.ones(len(a), bool)
        fresh[1:] = (piece[1:] != piece[:-1]) | (lo[1:] != hi[:-1] + 1)
        chain = np.cumsum(fresh) - 1
        open_ = (np.bincount(chain, edge, len(a)) > 0)[chain] if len(a) else edge
        even = (b - a) % 2 == 0
        upto = np.cumsum(even) - even
        shift = np.where(open_, 0, (upto - upto[np.flatnonzero(fresh)][chain]) % 2) if len(a) else upto
        length = b - a + 2 - shift
        length = np.where(open_, length, length // 2 * 2)
        keep = np.flatnonzero(open_ | (length >= least))
        at = (a - 2 + shift)[keep]
        start = (lo - 2 + shift)[keep]
        made = {"start": start, "end": start + length[keep], "open": open_[keep], "one": p.code[at].astype(np.int64), "two": p.code[at + 1].astype(np.int64)}
        return piece[keep], made

    return fn


def tandem_runs(df: DataFrame, total: int, size: int = CHUNK, pieces: DataFrame | None = None) -> DataFrame:
    """Repeated pairs of bases of at least ``total`` bases: (seq_id, start, end, motif), 0-based half-open, without overlap."""
    least = 2 * (total // 2)
    found = kernel.scan(_pieces(df, 2, 0, size) if pieces is None else pieces, tandem_stretches(least), "start long, end long, open boolean, one long, two long")
    columns = ["seq_id", "start", "end", "one", "two"]
    open_ = found.where("open").select("seq_id", (F.col("start") + 2).alias("lo"), F.col("end").alias("hi"), "one", "two")
    seams = _joined(open_, 0, {"one": F.min_by("one", "lo"), "two": F.min_by("two", "lo")}).where(F.col("hi") - F.col("lo") + 2 >= least)
    order = Window.partitionBy("seq_id").orderBy("lo")
    apart = F.coalesce(F.col("lo") != F.lag("hi").over(order) + 1, F.lit(True)).cast("int")
    chained = seams.withColumn("_new", apart).withColumn("_chain", F.sum("_new").over(order))
    earlier = Window.partitionBy("seq_id", "_chain").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(((F.col("hi") - F.col("lo")) % 2 == 0).cast("int")).over(earlier), F.lit(0)) % 2
    moved = chained.withColumn("_shift", shift).withColumn("start", F.col("lo") - 2 + F.col("_shift"))
    length = F.floor((F.col("hi") - F.col("start")) / 2) * 2
    swap = F.col("_shift") == 1
    resolved = moved.where(length >= least).select(
        "seq_id", "start", (F.col("start") + length).cast("long").alias("end"),
        F.when(swap, F.col("two")).otherwise(F.col("one")).alias("one"), F.when(swap, F.col("one")).otherwise(F.col("two")).alias("two"))
    whole = found.where("NOT open").select(*columns).unionByName(resolved.select(*columns))
    return whole.select("seq_id", "start", "end", F.concat(base_of(F.col("one")), base_of(F.col("two"))).alias("motif"))


def quadruplex_clusters(pattern: str = G4):
    """Kernel: matches inside clusters of runs of G with at most LOOP other bases between them; no match reaches beyond a cluster.

    Clusters near the chunk's ends are open and come with their text up to those ends.
    """
    find = re.compile(pattern.encode()).finditer

    def fn(p: kernel.Pieces):
        g = p.ahead(p.code == 2, False)[: len(p.code) + 2]
        triple = g[:-2] & g[1:-1] & g[2:]
        inside = p.piece[np.minimum(p.at + 2, len(p.code) - 1)] == p.piece
        triple = triple[: len(p.code)] & inside & (p.at + 2 < len(p.code))
        mark = triple.copy()
        mark[1:] |= triple[:-1]
        mark[2:] |= triple[:-2]
        at = np.flatnonzero(mark & (p.i >= p.core_start[p.piece]) & (p.i < p.core_end[p.piece]))
        cut = np.flatnonzero((np.diff(at) > LOOP + 1) | (np.diff(p.piece[at]) > 0))
        first, last = at[np.append(0, cut + 1)] if len(at) else at, at[np.append(cut, len(at) - 1)] + 1 if len(at) else at
        piece, data = p.piece[first], p.data.tobytes()
        shift = p.piece_start - p.begin
        left = (p.i[first] - p.core_start[piece] <= LOOP) & (p.core_start[piece] > 0)
        right = (p.core_end[piece] - p.i[last - 1] - 1 <= LOOP) & (p.core_end[piece] < p.n[piece])
        rows = []
        for a, b, q, l, r in zip(first.tolist(), last.tolist(), piece.tolist(), left.tolist(), right.tolist()):
            if l or r:
                a, b = (int(p.core_start[q] - shift[q]) if l else a), (int(p.core_end[q] - shift[q]) if r else b)
                rows.append((q, a + shift[q], b + shift[q], data[a:b].decode()))
            elif b - a >= SHORTEST_G4:
                rows += [(q, a + m.start() + shift[q], a + m.end() + shift[q], None) for m in find(data[a:b])]
        made = {n: np.array([x[i + 1] for x in rows], np.int64) for i, n in enumerate(("lo", "hi"))}
        return np.array([x[0] for x in rows], np.int64), made | {"text": pa.array([x[3] for x in rows], pa.string())}

    return fn


def quadruplexes(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """Matches of the quadruplex pattern, from left to right without overlap: (seq_id, start, end), 0-based half-open."""
    from spanframe.operators.sequence.motifs import pattern_hits

    found = kernel.scan(_pieces(df, 2, 2, size), quadruplex_clusters(), "lo long, hi long, text string")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "text"))), lambda s: s["text"]), "")
    open_ = _joined(found.where("text IS NOT NULL"), 0, {"text": text})
    keyed = open_.select(F.struct("seq_id", "lo").alias("seq_id"), F.col("text").alias("sequence"))
    hits = pattern_hits(keyed, G4, F.col("sequence")).select(F.col("seq_id.seq_id").alias("seq_id"), *[(F.col("seq_id.lo") + F.col(c)).alias(c) for c in ("start", "end")])
    return found.where("text IS NULL").select("seq_id", F.col("lo").alias("start"), F.col("hi").alias("end")).unionByName(hits)


def island_openings(width: int, step: int, least_gc: float, least_ratio: float):
    """Kernel: per piece, the windows on a grid of ``step`` bases that qualify while the window one step before does not."""

    def fn(p: kernel.Pieces):
        c, g = p.code == 1, p.code == 2
        n_c, n_g, n_p, n_known = (np.concatenate([[0], np.cumsum(v)]) for v in (c, g, c & np.append(g[1:], False), p.code < 4))

        def good(at):
            cc, gg, pairs, known = n_c[at + width] - n_c[at], n_g[at + width] - n_g[at], n_p[at + width - 1] - n_p[at], n_known[at + width] - n_known[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                return (known > 0) & ((cc + gg) / known >= least_gc) & (cc * gg > 0) & (pairs / (cc * gg / (width - 1)) >= least_ratio)

        at = p.core(width)
        at = at[p.i[at] % step == 0]
        here = good(at)
        before = np.zeros(len(at), bool)
        held = np.flatnonzero(p.i[at] >= step)
        before[held] = good(at[held] - step)
        opens = at[here & ~before]
        which, count = np.unique(p.piece[opens], return_counts=True)
        return which, {"opens": count.astype(np.int64)}

    return fn


def _cluster_matches(p: kernel.Pieces, base: int, find) -> np.ndarray:
    """Matches of a quadruplex pattern of one base in each whole piece: only clusters of its runs, long enough, are searched."""
    own = p.ahead(p.code == base, False)
    triple = own[: len(p.code)] & own[1 : len(p.code) + 1] & own[2 : len(p.code) + 2] & (p.i + 2 < p.n[p.piece])
    mark = triple.copy()
    mark[1:] |= triple[:-1]
    mark[2:] |= triple[:-2]
    at = np.flatnonzero(mark)
    out = np.zeros(len(p.begin), np.int64)
    if not len(at):
        return out
    cut = np.flatnonzero((np.diff(at) > LOOP + 1) | (np.diff(p.piece[at]) > 0))
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1
    data = p.data.tobytes()
    for i in np.flatnonzero(last - first >= SHORTEST_G4).tolist():
        out[p.piece[first[i]]] += sum(1 for _ in find(data[first[i] : last[i]]))
    return out


def structure_counts(alternating: int, single: int, hairpins):
    """Kernel: per whole piece, quadruplexes of either strand, alternating runs and runs of one base class of some length, beside what ``hairpins`` gives."""
    finds = [(2, re.compile(G4.encode()).finditer), (1, re.compile(G4.replace("G", "C").encode()).finditer)]

    def fn(p: kernel.Pieces):
        which, made = hairpins(p)
        own = _PURINE[p.code]
        same_class = np.zeros(len(own), bool)
        same_class[1:] = (own[1:] == own[:-1]) & (own[1:] < 2)
        same_class[p.begin[p.begin < len(own)]] = False

        def long_runs(link: np.ndarray, least: int) -> np.ndarray:
            a, b = _stretches(link, p.piece)
            return np.bincount(p.piece[a[b - a + 1 >= least]], minlength=len(p.begin)).astype(np.int64)

        counts = {"g4": sum(_cluster_matches(p, base, find) for base, find in finds), "zdna": long_runs(_links(p, "alternating"), alternating), "triplex": long_runs(same_class, single)}
        return which, counts | made

    return fn

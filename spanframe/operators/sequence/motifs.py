"""Motifs: pattern hits, hairpins, repeats, non-B densities, islands, PWM hits."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.seqexpr import (
    base_count,
    gc_count,
    gc_fraction,
    normalise,
    pair_count,
    reverse_complement,
    step_sum,
    step_total,
    with_step_counts,
)
from spanframe.operators.merge import merge_intervals
from spanframe.operators.sequence import kernel, runs
from spanframe.operators.sequence.steps import CHUNK, chunks, known_windows
from spanframe.session import written

# Motif patterns.
G4 = runs.G4
C4 = r"C{3,}\w{1,7}C{3,}\w{1,7}C{3,}\w{1,7}C{3,}"
ALTERNATING_8 = r"(?:RY){4,}|(?:YR){4,}"
ALTERNATING_12 = r"(?:[AG][CT]){6,}|(?:[CT][AG]){6,}"
TRIPLEX = (r"[AG]{15,}", r"[CT]{15,}")


def runs_pattern(length: int) -> str:
    return "|".join(f"{b}{{{length},}}" for b in K.BASES)


def tandem_pattern(total: int) -> str:
    return "|".join(f"(?:{d}){{{total // 2},}}" for d in K.DINUCLEOTIDES)


def pattern_hits(df: DataFrame, pattern: str, text: Column | None = None) -> DataFrame:
    """Non-overlapping matches with their positions: (seq_id, start, end, hit).

    A match starts after all earlier gaps and matches; gaps and matches come
    from one split and one extract in the scan stage, and only their lengths are
    accumulated.
    """
    seq = normalise(F.col("sequence")) if text is None else text
    parts = df.select("seq_id", seq.alias("_s")).select(
        "seq_id", F.split("_s", pattern).alias("_gaps"), F.regexp_extract_all("_s", F.lit(pattern), F.lit(0)).alias("_m")
    ).where(F.size("_m") > 0)
    pairs = parts.select("seq_id", F.posexplode(F.arrays_zip("_gaps", "_m")).alias("k", "z")).where(
        F.col("z._m").isNotNull()
    )
    order = Window.partitionBy("seq_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    sized = pairs.withColumns({"_g": F.length("z._gaps"), "_l": F.length("z._m")})
    end = F.sum(F.col("_g") + F.col("_l")).over(order)
    return sized.withColumn("end", end).select(
        "seq_id", (F.col("end") - F.col("_l")).alias("start"), "end", F.col("z._m").alias("hit")
    )


def motif_hits(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """G-quadruplexes, Z-prone alternating runs and homopolymers of five or more, with positions: chunk by chunk, merged over seams."""
    none = F.lit(None).cast("double").alias("score")
    g4 = runs.quadruplexes(df, size).select("seq_id", "start", "end", F.lit("g_quadruplex").alias("motif"), none)
    homo = runs.base_runs(df, "same", 5, size).select("seq_id", "start", "end", F.concat(F.lit("poly_"), runs.base_of(F.col("one"))).alias("motif"), none)
    return g4.unionByName(z_runs(df, size)).unionByName(homo)


def z_runs(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """Alternating purine/pyrimidine runs of eight or more with a mean Z penalty under 2.5; whole pairs only."""
    found = runs.base_runs(df, "alternating", 8, size)
    odd = (F.col("end") - F.col("start")) % 2
    end = F.col("end") - odd
    total = (F.col("z") - odd * F.col("z_last")) / F.lit(float(K.STEP_SCALE))
    scored = found.select("seq_id", "start", end.alias("end"), (total / (end - F.col("start") - 1)).alias("score"))
    return scored.where(F.col("score") < 2.5).select("seq_id", "start", "end", F.lit("z_dna_prone").alias("motif"), F.round("score", 2).alias("score"))


def inverted_repeats(df: DataFrame, stem: int = 6, min_loop: int = 3, max_loop: int = 12, size: int = CHUNK) -> DataFrame:
    """Hairpin stems: positions whose reverse complement first follows after a loop of allowed length.

    The partner lies within a fixed reach, so each position looks ahead inside
    its own chunk; nothing is joined.
    """
    pieces = chunks(df.select("seq_id", "sequence"), 0, 2 * stem + max_loop, size, spread=False)
    return kernel.scan(pieces, kernel.stems(stem, min_loop, max_loop), "start int, end int, loop_length int, stem_5prime string")


def homopolymers(df: DataFrame, length: int = K.FLAG_HOMOPOLYMER, size: int = CHUNK, pieces: DataFrame | None = None) -> DataFrame:
    """Runs of one base of at least ``length``, 1-based closed."""
    return runs.base_runs(df, "same", length, size, pieces).select(
        "seq_id", (F.col("start") + 1).alias("start"), "end", runs.base_of(F.col("one")).alias("base"), (F.col("end") - F.col("start")).cast("int").alias("length"))


def dinuc_repeats(df: DataFrame, total: int = K.FLAG_DINUC_REPEAT, size: int = CHUNK, pieces: DataFrame | None = None) -> DataFrame:
    """Tandem dinucleotides of at least ``total`` bases, 1-based closed."""
    return runs.tandem_runs(df, total, size, pieces).select(
        "seq_id", (F.col("start") + 1).alias("start"), "end", "motif", (F.col("end") - F.col("start")).cast("int").alias("length"))


def kmers(df: DataFrame, k: int, size: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every k-mer of known bases with its 0-based position."""
    cut = bases(chunks(df.select("seq_id", *keep, "sequence"), 0, k - 1, size, spread=False), keep).where(
        (F.col("i") < F.col("core_end")) & (F.col("i") <= F.col("n") - k)
    )
    return cut.select("seq_id", *keep, "i", at(0, k).alias("kmer")).where(~F.col("kmer").contains("N"))


def spelled(code: Column, k: int) -> Column:
    """Bases of a code of two bits a base."""
    return F.concat(*[F.substring(F.lit("ACGT"), F.shiftright(code, 2 * (k - 1 - j)).bitwiseAND(3).cast("int") + 1, F.lit(1)) for j in range(k)])


def kmer_repeats(df: DataFrame, k: int = K.FLAG_KMER, size: int = CHUNK, pieces: DataFrame | None = None) -> DataFrame:
    """Direct and inverted k-mer repeats: (seq_id, kind, kmer, first, second), 1-based starts.

    Direct: first and second occurrence of a k-mer. Inverted: the first place
    where a k-mer's reverse complement occurs after it, with the closest earlier
    occurrence of the k-mer. Strand pairs share one canonical key; a sequence's pieces
    meet as text, and only k-mers that occur again leave the kernel. ``pieces`` that are cut already have the bases of their seq_id as ``_total``.
    """
    if pieces is None:
        total = F.sum(F.length("sequence")).over(Window.partitionBy("seq_id"))
        pieces = chunks(df.where("seq_id IS NOT NULL").select("seq_id", "sequence", total.alias("_total")), 0, k - 1, size, spread=False)
    else:
        pieces = pieces.where("seq_id IS NOT NULL")
    found = ", ".join(f"{c} long" for c in ("canon", "f1", "r1", "f2", "r2", "r_after", "f_after", "f_before", "r_before"))
    third = kernel.by_kmer(pieces, "seq_id", "_total", k, kernel.canonical_kmers(k), kernel.repeat_places, found)
    third = third.withColumn("canon", spelled(F.col("canon"), k))
    other = reverse_complement(F.col("canon"))
    found = F.array(
        F.struct(F.lit("direct").alias("kind"), F.col("canon").alias("kmer"), F.col("f1").alias("a"), F.col("f2").alias("b")),
        F.struct(F.lit("direct").alias("kind"), other.alias("kmer"), F.col("r1").alias("a"), F.col("r2").alias("b")),
        F.struct(F.lit("inverted").alias("kind"), F.col("canon").alias("kmer"), F.col("f_before").alias("a"),
                 F.col("r_after").alias("b")),
        F.struct(F.lit("inverted").alias("kind"), other.alias("kmer"), F.col("r_before").alias("a"),
                 F.col("f_after").alias("b")),
    )
    return third.select("seq_id", F.inline(found)).where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(
        "seq_id", "kind", "kmer", (F.col("a") + 1).alias("first"), (F.col("b") + 1).alias("second")
    )


def cpg_sites(df: DataFrame, reach: int = 500, size: int = CHUNK) -> DataFrame:
    """Every CG with the GC fraction of ``reach`` bases on both sides, clipped at the ends: prefix counts inside a chunk and its halo."""
    pieces = chunks(df.select("seq_id", "sequence"), reach, reach, size)
    return kernel.scan(pieces, kernel.cpg_places(reach), "pos long, gc_content double")


def cpg_islands(df: DataFrame, merge_gap: int = 0, retest: bool = False, size: int = CHUNK) -> DataFrame:
    """CpG islands: union of 200-bp windows with GC >= 0.5 and observed/expected >= 0.6.

    ``merge_gap=100, retest=True`` is the genome variant (nearby islands join and
    must pass again as a whole); the default keeps the plain union. Chunks give runs
    of qualifying windows; island counts come from chunk slices, never from a whole sequence.
    """
    plain = df.select("seq_id", "sequence")
    width, merged = K.ISLAND_LENGTH, island_spans(df, merge_gap, size)
    counted = _slice_counts(merged, plain, size)
    length = F.col("end_pos") - F.col("start_pos")
    product = F.col("_c").cast("double") * F.col("_g")
    out = counted.select(
        "seq_id", "start_pos", "end_pos", length.alias("length_bp"),
        F.when(F.col("_known") > 0, (F.col("_c") + F.col("_g")) / F.col("_known")).otherwise(0.0).alias("gc"),
        F.when(product > 0, F.col("_p") / (product / (length - 1))).otherwise(0.0).alias("obs_exp_cpg"),
        F.when(product > 0, F.col("_p") * length / product).otherwise(0.0).alias("_oe_n"),
        ((F.col("_c") + F.col("_g")) / length).alias("_gc_n"), F.col("_p").alias("cpg_count"),
    )
    if retest:
        out = out.where((F.col("length_bp") >= width) & (F.col("_gc_n") >= K.ISLAND_GC) & (F.col("_oe_n") >= K.ISLAND_OE))
    return out.drop("_oe_n", "_gc_n")


def island_spans(df: DataFrame, merge_gap: int = 0, size: int = CHUNK, pieces: DataFrame | None = None) -> DataFrame:
    """Places of CpG islands alone: (seq_id, start_pos, end_pos)."""
    width = K.ISLAND_LENGTH
    cut = pieces is not None
    if not cut:
        pieces = chunks(df.select("seq_id", "sequence"), 0, width, size, spread=False)
    grouped = kernel.scan(pieces.where("seq_id IS NOT NULL"), kernel.island_runs(width, K.ISLAND_GC, K.ISLAND_OE), "start_pos long, end_pos long")
    if cut:
        grouped = written(grouped, "runs")  # merging reads them twice
    return merge_intervals(grouped, merge_gap, keys=("seq_id",)).select("seq_id", "start_pos", "end_pos")


def _slice_counts(regions: DataFrame, sequences: DataFrame, size: int) -> DataFrame:
    """C, G, CG and known bases of each region (seq_id, start_pos, end_pos), summed over chunk slices."""
    wanted = regions.withColumn(
        "chunk", F.explode(F.sequence(F.floor(F.col("start_pos") / size).cast("int"),
                                      F.floor((F.col("end_pos") - 1) / size).cast("int")))
    )
    pieces = chunks(sequences, 0, 1, size, spread=False)
    joined = wanted.join(pieces, ["seq_id", "chunk"])
    low = F.greatest(F.col("start_pos"), F.col("core_start"))
    high = F.least(F.col("end_pos"), F.col("core_end"))
    # One base more, if still inside the region, so a CG across the cut is counted once.
    pair_high = F.least(F.col("end_pos"), F.col("core_end") + 1)
    text = joined.select(
        "seq_id", "start_pos", "end_pos",
        F.substring("piece", (low - F.col("core_start") + 1).cast("int"), (high - low).cast("int")).alias("_t"),
        F.substring("piece", (low - F.col("core_start") + 1).cast("int"), (pair_high - low).cast("int")).alias("_tp"),
    )
    t = F.col("_t")
    return text.groupBy("seq_id", "start_pos", "end_pos").agg(
        F.sum(base_count(t, "C")).alias("_c"), F.sum(base_count(t, "G")).alias("_g"),
        F.sum(pair_count(F.col("_tp"), "CG")).alias("_p"), F.sum(F.length(t) - base_count(t, "N")).alias("_known"),
    )


def nonb_density(df: DataFrame, size: int = 1000) -> DataFrame:
    """Non-B structures per kb for every window of each sequence."""
    n = F.length("window")
    pieces = known_windows(df, size).repartition("seq_id", "start_pos").select(
        "seq_id", "start_pos", "end_pos", F.col("window").alias("piece"), n.alias("n"), F.lit(0).alias("core_start"), n.alias("core_end"), F.lit(0).alias("piece_start"))
    # R-loop score over 50-bp windows every 25 bp; hairpins with a stem of six and a partner within the next 14 bases.
    counted = kernel.scan(pieces, runs.structure_counts(12, 15, kernel.skew_and_hairpins(50, 25, 6, 14)), "g4 long, zdna long, triplex long, rloop double, hairpins long", "start_pos", "end_pos")
    kb = (F.col("end_pos") - F.col("start_pos")) / 1000.0
    out = counted.withColumns({"cruciform": F.col("hairpins") / kb, **{c: F.col(c) / kb for c in ("g4", "zdna", "triplex")}})
    total = F.col("g4") + F.col("zdna") + F.col("cruciform") + F.col("rloop") + F.col("triplex")
    return out.select("seq_id", "start_pos", "end_pos", "g4", "zdna", "cruciform", "triplex", "rloop", total.alias("total"))


def pwm_log_odds(matrix: list[list[float]]) -> list[list[float]]:
    """Rows A, C, G, T. Probability columns become log2 odds against 0.25, floored at 0.01."""
    import math

    columns = list(zip(*matrix, strict=True))
    if all(abs(sum(c) - 1.0) < 0.05 for c in columns):
        return [[math.log2(max(p, 0.01) / 0.25) for p in row] for row in matrix]
    return matrix


def pwm_scan(df: DataFrame, matrix: list[list[float]], threshold: float, size: int = CHUNK) -> DataFrame:
    """Positions scoring at least ``threshold`` on either strand; windows with unknown bases do not score."""
    odds = pwm_log_odds(matrix)
    length = len(odds[0])
    reverse = [row[::-1] for row in odds[::-1]]
    pieces = chunks(df.select("seq_id", "sequence"), 0, length - 1, size, spread=False)
    return kernel.scan(pieces, kernel.pwm_hits(odds, reverse, threshold), "start long, end long, strand string, score double")


def restriction_sites(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """Every occurrence (overlapping ones too) of the fixed recognition sites, 1-based."""
    names, sites = list(K.RESTRICTION_SITES), list(K.RESTRICTION_SITES.values())
    pieces = chunks(df.select("seq_id", "sequence"), 0, max(map(len, sites)) - 1, size, spread=False)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("site"))
    found = kernel.scan(pieces, kernel.site_places(K.RESTRICTION_SITES), "site int, i long")
    return found.select(
        "seq_id", pick(names).alias("enzyme"), pick(sites).alias("site"), (F.col("i") + 1).cast("int").alias("position"),
        (F.col("i") + F.length(pick(sites))).cast("int").alias("end"))


def gc_windows(df: DataFrame, window: int = 100, pieces: DataFrame | None = None) -> DataFrame:
    """GC fraction of consecutive windows of each sequence: (seq_id, w, start, end, gc), 1-based."""
    if pieces is None:
        pieces = chunks(df.select("seq_id", "sequence"), 0, window - 1, spread=False)
    counted = kernel.scan(pieces, kernel.gc_counts(window), "start int, end int, _gc long, _known long")
    return counted.select(
        "seq_id", ((F.col("start") - 1) / window).cast("int").alias("w"), "start", "end",
        F.when(F.col("_known") > 0, F.col("_gc") / F.col("_known")).otherwise(0.0).alias("gc"),
    )

"""Thermodynamics and constant-table summaries from step counts; profiles from chunked steps."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.seqexpr import (
    base_count,
    clean,
    gc_count,
    gc_fraction,
    normalise,
    pair_count,
    step_sum,
    step_total,
    with_step_counts,
)
from spanframe.operators.sequence import kernel
from spanframe.operators.sequence.steps import CHUNK, bases, at, by_code, chunks, known_windows, step_code, steps

STRUCTURE = ("roll", "tilt", "twist", "rise", "slide", "shift", "deformability")
GROOVES = ("major_groove_width", "major_groove_depth", "minor_groove_width", "minor_groove_depth")


def _counted(df: DataFrame, drop_unknown: bool = False) -> DataFrame:
    text = normalise(F.col("sequence"))
    return with_step_counts(df.withColumn("sequence", clean(text) if drop_unknown else text))


def _mean(table: dict[str, float]) -> Column:
    return F.when(step_total() > 0, step_sum(table) / step_total())


def salt_delta_g(salt_mm: float) -> Column:
    """Salt-corrected total: entropy gains 0.368 ln[Na] per step."""
    entropy = step_sum(K.NN_DELTA_S) + step_total() * (K.SALT_ENTROPY * math.log(salt_mm / 1000.0))
    return step_sum(K.NN_DELTA_H) - K.KELVIN_37 * entropy / 1000.0


def thermo_columns(salt_mm: float = 1000.0) -> dict[str, Column]:
    total = salt_delta_g(salt_mm)
    return {
        "n_steps": step_total(),
        "total_delta_h": F.round(step_sum(K.NN_DELTA_H), 2),
        "total_delta_s": F.round(step_sum(K.NN_DELTA_S), 2),
        "total_delta_g_37": F.round(step_sum(K.NN_DELTA_G37), 2),
        "total_delta_g_salt": F.round(total, 2),
        "mean_delta_g_per_step": F.when(step_total() > 0, F.round(total / step_total(), 3)).otherwise(0.0),
    }


def thermo_summary(df: DataFrame, salt_mm: float = 1000.0) -> DataFrame:
    """Nearest-neighbour totals per sequence; unknown steps are skipped."""
    cols = thermo_columns(salt_mm)
    return _counted(df).select("seq_id", *[c.alias(k) for k, c in cols.items()])


def _single_and_shared(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences that have a seq_id to themselves, and those that share one; without those that have none."""
    counted = df.where("seq_id IS NOT NULL").select("seq_id", "sequence", F.count(F.lit(1)).over(Window.partitionBy("seq_id")).alias("_rows"))
    single, shared = (counted.where(c).drop("_rows") for c in ("_rows = 1", "_rows > 1"))
    return single, shared


def _rounded(micro: np.ndarray, digits: int) -> np.ndarray:
    """Whole millionths as numbers of ``digits`` places, half away from zero."""
    if digits >= 6:
        return micro / 1e6
    unit = 10 ** (6 - digits)
    return np.sign(micro) * ((np.abs(micro) + unit // 2) // unit) / 10**digits


def thermo_profile(df: DataFrame, salt_mm: float = 1000.0, size: int = CHUNK, digits: int = 2) -> DataFrame:
    """Per-step energies and the running salt-corrected total.

    Steps are made in the kernel and leave it as the rows of the result; nothing is sorted or joined. Sums run over whole micro-kcal, so they do
    not depend on the order of addition. Rows that share a seq_id have one running total.
    """
    term = K.SALT_ENTROPY * math.log(salt_mm / 1000.0)
    micro = {d: round((K.NN_DELTA_H[d] - K.KELVIN_37 * (K.NN_DELTA_S[d] + term) / 1000.0) * 1e6) for d in K.DINUCLEOTIDES}
    single, shared = _single_and_shared(df)
    whole = [micro[d] for d in K.DINUCLEOTIDES]
    tables = {n: np.array([float(t[d]) for d in K.DINUCLEOTIDES]) for n, t in (("delta_h", K.NN_DELTA_H), ("delta_s", K.NN_DELTA_S), ("delta_g_37", K.NN_DELTA_G37))}
    tables["delta_g_salt"] = _rounded(np.array(whole), digits)
    names, running = pa.array(K.DINUCLEOTIDES), kernel.RunningSteps(whole)

    def fn(p: kernel.Pieces):
        which, i, step, run = running(p)
        return which, {"i": i.astype(np.int32), "dinucleotide": names.take(pa.array(step)), **{n: t[step] for n, t in tables.items()}, "cumulative_dg": _rounded(run, digits)}

    schema = "i int, dinucleotide string, " + ", ".join(f"{n} double" for n in (*tables, "cumulative_dg"))
    return kernel.scan(chunks(single, 0, 1, size, spread=False), fn, schema).unionByName(_shared_profile(shared, micro, size, digits))


def _shared_profile(df: DataFrame, micro: dict[str, int], size: int, digits: int) -> DataFrame:
    """The profile with a row per step in Spark, for rows that share a seq_id: they lie in one window of steps.

    Chunk totals come from step counts of the compact chunk strings; only those
    totals are accumulated along the sequence. Sums run over whole micro-kcal,
    so they do not depend on the order of addition.
    """
    totals = with_step_counts(
        chunks(df.select("seq_id", "sequence"), 0, 1, size, spread=False), "piece"
    ).select("seq_id", "chunk", reduce(add, [F.col(f"c_{d}").cast("long") * F.lit(m) for d, m in micro.items()]).alias("_t"))
    earlier = Window.partitionBy("seq_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("seq_id", "chunk", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_offset"))
    known = steps(df.select("seq_id", "sequence"), size=size).where(F.col("code").isNotNull() & F.col("core"))
    salted = by_code(F.col("code"), micro).cast("long")
    inside = Window.partitionBy("seq_id", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    run = known.withColumn("_g", salted).withColumn("_run", F.sum("_g").over(inside))
    return run.join(offsets, ["seq_id", "chunk"]).select(
        "seq_id", "i", "dinucleotide",
        by_code(F.col("code"), K.NN_DELTA_H).alias("delta_h"), by_code(F.col("code"), K.NN_DELTA_S).alias("delta_s"),
        by_code(F.col("code"), K.NN_DELTA_G37).alias("delta_g_37"), F.round(F.col("_g") / 1e6, digits).alias("delta_g_salt"),
        F.round((F.col("_offset") + F.col("_run")) / 1e6, digits).alias("cumulative_dg"),
    )


def _internal_mono() -> Column:
    """Mono extinction of all bases but the two ends."""
    seq = F.col("sequence")
    table = F.create_map(*[F.lit(x) for b, v in K.MONO_EXTINCTION.items() for x in (b, v)])
    ends = F.coalesce(F.try_element_at(table, F.substring(seq, 1, 1)), F.lit(0)) + F.coalesce(
        F.try_element_at(table, F.substring(seq, -1, 1)), F.lit(0)
    )
    total = reduce(add, [base_count(seq, b) * F.lit(v) for b, v in K.MONO_EXTINCTION.items()])
    return F.when(F.length(seq) >= 2, total - ends).otherwise(0)


def extinction(df: DataFrame) -> DataFrame:
    """Molar extinction at 260 nm: step sum minus internal bases."""
    return _counted(df).select(
        "seq_id", step_total().alias("n_steps"),
        (step_sum(K.EXTINCTION) - _internal_mono()).alias("total_extinction_260"),
        step_sum(K.EXTINCTION).alias("sum_dinucleotide_ext"),
        _internal_mono().cast("double").alias("sum_internal_mono_ext"),
    )


def form_propensity(df: DataFrame) -> DataFrame:
    return _counted(df).select(
        "seq_id", step_total().alias("n_steps"), F.round(_mean(K.A_FORM), 3).alias("mean_a_form_propensity"),
        F.round(_mean(K.Z_FORM), 3).alias("mean_z_form_propensity"),
        F.round(step_sum(K.Z_FORM), 2).alias("total_z_penalty"),
    )


def groove(df: DataFrame) -> DataFrame:
    return _counted(df).select(
        "seq_id", step_total().alias("n_steps"),
        *[F.round(_mean(K.STEP_PROPERTIES[g]), 2).alias(f"mean_{g}") for g in GROOVES],
    )


def structural(df: DataFrame) -> DataFrame:
    return _counted(df).select(
        "seq_id", step_total().alias("n_steps"),
        *[(F.round(_mean(K.STEP_PROPERTIES[p]), 3) + F.lit(0.0)).alias(f"mean_{p}") for p in STRUCTURE],
    )


def gc_cpg(df: DataFrame) -> DataFrame:
    """GC fraction, CpG count and observed/expected (both denominators: n-1 and n)."""
    seq = F.col("sequence")
    cpg, c, g, n = pair_count(seq, "CG"), base_count(seq, "C"), base_count(seq, "G"), F.length(seq)
    product = F.col("_c").cast("double") * F.col("_g")
    return (
        df.withColumn("sequence", normalise(seq))
        .withColumns({"gc_content": gc_fraction(seq), "cpg_count": cpg, "_c": c, "_g": g, "length_bp": n})
        .select(
            "seq_id", "length_bp", "gc_content", "cpg_count",
            F.when((product > 0) & (n >= 2), F.col("cpg_count") / (product / (n - 1))).otherwise(0.0).alias("obs_exp"),
            F.when((product > 0) & (n >= 2), F.col("cpg_count") * n / product).otherwise(0.0).alias("obs_exp_window"),
        )
    )


def melting_columns(salt_mm: float, oligo_nm: float, cut: Column, length: Column, gc: Column) -> dict[str, Column]:
    """Two-state temperature up to 60 known bases, the empirical formula beyond.

    ``cut`` is the sequence without unknown bases, whose step counts are in scope.
    """
    sodium = salt_mm / 1000.0

    def ends(table: dict[str, float]) -> Column:
        per_end = lambda b: F.when(b.isin("G", "C"), table["GC"]).otherwise(table["AT"])
        return per_end(F.substring(cut, 1, 1)) + per_end(F.substring(cut, -1, 1))

    enthalpy = (step_sum(K.NN_DELTA_H) + ends(K.INIT_DH)) * 1000.0
    entropy = (
        step_sum(K.NN_DELTA_S) + ends(K.INIT_DS) + step_total() * (K.SALT_ENTROPY * math.log(sodium))
        + K.GAS_CONSTANT_CAL * math.log(oligo_nm * 1e-9 / 4.0)
    )
    near = F.when(entropy >= 0, F.lit(0.0)).otherwise(enthalpy / entropy - 273.15)
    far = 81.5 + 16.6 * math.log10(sodium) + 41.0 * gc - 600.0 / length
    short = (F.length(cut) <= K.OLIGO_LIMIT) & (F.length(cut) >= 2) & (step_total() > 0)
    return {
        "melting_temp": F.when(short, near).when(length > 0, far).otherwise(0.0),
        "tm_method": F.when(short, "nearest_neighbor").otherwise("empirical"),
    }


def melting_temp(df: DataFrame, salt_mm: float = 1000.0, oligo_nm: float = 250.0) -> DataFrame:
    text = normalise(F.col("sequence"))
    staged = df.withColumns(
        {"_length": F.length(text), "_gc": gc_fraction(text), "sequence": clean(text)}
    )
    cols = melting_columns(salt_mm, oligo_nm, F.col("sequence"), F.col("_length"), F.col("_gc"))
    return with_step_counts(staged).select(
        "seq_id", F.round(cols["melting_temp"], 1).alias("melting_temp"), cols["tm_method"].alias("tm_method")
    )


def contextual(df: DataFrame, window: int = 10, size: int = CHUNK) -> DataFrame:
    """Local stability and flexibility per sequence: mean and largest bubble propensity, mean flexibility.

    Sums are made inside chunks. Rows that share a seq_id lie in one window of steps, and only they have a row per step.
    """
    half = window // 2
    dg, trx = ([round(t[d] * K.STEP_SCALE) for d in K.DINUCLEOTIDES] for t in (K.NN_DELTA_G37, K.DEFORMABILITY))
    counted = df.select("seq_id", "sequence", F.count(F.lit(1)).over(Window.partitionBy("seq_id")).alias("_rows"))
    single, repeated = (counted.where(c).drop("_rows") for c in ("_rows = 1", "_rows > 1"))
    pieces = chunks(single, half, half + 1, size, spread=False)
    sums = kernel.scan(pieces, kernel.context_sums(half, dg, trx, K.STEP_SCALE), "n long, known long, bubble double, most double, bend double")
    known = F.sum("known")
    means = {
        "mean_bubble_propensity": (F.try_divide(F.sum("bubble"), known), F.avg("bubble_propensity"), 4),
        "max_bubble_propensity": (F.max("most"), F.max("bubble_propensity"), 4),
        "mean_flexibility": (F.try_divide(F.sum("bend"), known), F.avg("local_flexibility"), 2),
    }
    fast = sums.groupBy("seq_id").agg(F.sum("n").alias("n_steps"), *[F.round(c, d).alias(k) for k, (c, _, d) in means.items()])
    slow = contextual_profile(repeated, window, size).groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n_steps"), *[F.round(c, d).alias(k) for k, (_, c, d) in means.items()])
    return fast.unionByName(slow)


def contextual_profile(df: DataFrame, window: int = 10, size: int = CHUNK) -> DataFrame:
    """Per-step local means over +-window//2 steps, unknown steps skipped."""
    half = window // 2
    cut = steps(df.select("seq_id", "sequence"), half, half, size).withColumns(
        {"dg": by_code(F.col("code"), K.NN_DELTA_G37), "trx": by_code(F.col("code"), K.DEFORMABILITY)}
    )
    near = Window.partitionBy("seq_id", "chunk").orderBy("i").rowsBetween(-half, half)
    local = cut.withColumns(
        {"local_stability": F.avg("dg").over(near), "local_flexibility": F.avg("trx").over(near)}
    ).where("core")
    return local.select(
        "seq_id", "i", "dg", "local_stability", (F.col("dg") - F.col("local_stability")).alias("context_deviation"),
        (1.0 / (1.0 + F.exp(-4.0 * (F.col("local_stability") + 1.2)))).alias("bubble_propensity"),
        "local_flexibility",
    )


def _bend_tables() -> list[np.ndarray]:
    return [np.radians([*(table[d] for d in K.DINUCLEOTIDES), 0.0]) for table in (K.ROLL, K.TILT, K.TWIST)]


def curvature_profile(df: DataFrame, window: int = 21, size: int = CHUNK) -> DataFrame:
    """Wedge-model curvature in degrees per step over a centred window, cut short at sequence ends.

    The length of a windowed vector sum does not depend on where the twist angle
    starts, so a chunk needs no carry.
    """
    half, tables = window // 2, _bend_tables()

    def fn(p: kernel.Pieces):
        at, bend = kernel.curvature_steps(p, *tables, half)
        pairs = np.stack([p.data[at], p.data[at + 1]], 1) if len(at) else np.zeros((0, 2), np.uint8)
        return p.piece[at], {"i": p.i[at], "dinucleotide": pa.array(np.ascontiguousarray(pairs).view("S2").ravel().astype("U2"), pa.string()), "curvature": bend}

    return kernel.scan(chunks(df.select("seq_id", "sequence"), half, half + 1, size, spread=False), fn, "i long, dinucleotide string, curvature double")


def curvature(df: DataFrame, window: int = 21, size: int = CHUNK) -> DataFrame:
    """Steps, mean and largest curvature of each sequence; only sums of chunks are shuffled."""
    half, tables = window // 2, _bend_tables()

    def fn(p: kernel.Pieces):
        at, bend = kernel.curvature_steps(p, *tables, half)
        which, first, n = np.unique(p.piece[at], return_index=True, return_counts=True)
        return which, {"n": n, "total": np.add.reduceat(bend, first) if len(at) else bend, "most": np.maximum.reduceat(bend, first) if len(at) else bend}

    sums = kernel.scan(chunks(df.select("seq_id", "sequence"), half, half + 1, size, spread=False), fn, "n long, total double, most double")
    return sums.groupBy("seq_id").agg(
        F.sum("n").alias("n_steps"), F.round(F.sum("total") / F.sum("n"), 3).alias("mean_curvature"), F.round(F.max("most"), 3).alias("max_curvature"),
    )


def melting_curve(windows: DataFrame, body_kelvin: float = 310.15) -> DataFrame:
    """Bubble propensity at body temperature, melting width (20 to 80 % open) and cooperativity per sequence.

    The open fraction depends on step counts alone. It grows with temperature,
    so the width is the gap between the first scan temperatures reaching 20 %
    and 80 %; unreached thresholds give 120.
    """
    gas = 1.987e-3
    # Scan from 20 to 140 C in half degrees.
    temperatures = [20.0 + 0.5 * i for i in range(241)]

    def open_share(kelvin: float) -> list[float]:
        weights = [math.exp((K.NN_DELTA_H[d] - kelvin * K.NN_DELTA_S[d] / 1000.0) / (gas * kelvin)) for d in K.DINUCLEOTIDES]
        return [w / (1.0 + w) for w in weights]

    counted = _counted(windows).withColumn("_n", step_total())
    counts = F.array(*[F.col(f"c_{d}").cast("double") for d in K.DINUCLEOTIDES])
    table = F.array(*[F.array(*[F.lit(p) for p in open_share(t + 273.15)]) for t in temperatures])
    share = F.transform(
        table, lambda row: F.aggregate(F.zip_with(row, F.col("_counts"), lambda p, c: p * c), F.lit(0.0), lambda a, x: a + x)
    )
    known = F.length(clean(F.col("sequence")))
    gc = gc_count(F.col("sequence"))
    body = reduce(add, [F.col(f"c_{d}") * F.lit(p) for d, p in zip(K.DINUCLEOTIDES, open_share(body_kelvin), strict=True)])
    staged = counted.withColumn("_counts", counts).withColumn("_open", share)
    first = lambda level: F.array_position(F.transform("_open", lambda s: F.try_divide(s, F.col("_n")) >= level), True)
    return staged.withColumns({"_t20": first(0.2), "_t80": first(0.8)}).select(
        "seq_id",
        F.coalesce(F.try_divide(body, F.col("_n")), F.lit(0.0)).alias("bubble_propensity"),
        F.when((F.col("_n") > 0) & (F.col("_t20") > 0) & (F.col("_t80") > 0), (F.col("_t80") - F.col("_t20")) * 0.5)
        .otherwise(120.0).alias("melting_width"),
        F.when(known > 0, 1e-5 * F.exp(2.0 * (1.0 - gc / known))).otherwise(1e-5).alias("melting_cooperativity"),
    )


def sbs_ddg(df: DataFrame, kelvin: float = 310.15, size: int = CHUNK) -> DataFrame:
    """Mean absolute change of stacking energy per substitution channel, 0 where the base never occurs."""
    energy = {d: K.NN_DELTA_H[d] - kelvin * K.NN_DELTA_S[d] / 1000.0 for d in K.DINUCLEOTIDES}

    def stack(pair: Column) -> Column:
        return F.coalesce(by_code(step_code(pair), energy), F.lit(0.0))

    cut = bases(chunks(df.select("seq_id", "sequence"), 1, 1, size)).where(
        (F.col("i") >= F.col("core_start")) & (F.col("i") < F.col("core_end")) & (F.col("i") > 0)
        & (F.col("i") < F.col("n") - 1)
    )
    triple = cut.select("seq_id", at(-1).alias("p"), at(0).alias("b"), at(1).alias("q"))
    counted = triple.where(F.col("b").isin("C", "T")).groupBy("seq_id", "p", "b", "q").agg(F.count(F.lit(1)).alias("k"))
    wild = stack(F.concat("p", "b")) + stack(F.concat("b", "q"))
    out = []
    for name, (ref, alt) in K.SBS_CHANNELS.items():
        mutant = stack(F.concat("p", F.lit(alt))) + stack(F.concat(F.lit(alt), "q"))
        here = F.col("b") == ref
        # Whole micro-kcal, so the mean does not depend on the order of addition.
        total = F.sum(F.when(here, F.round(F.abs(mutant - wild) * 1e6).cast("long") * F.col("k")))
        out.append(F.coalesce(F.try_divide(total, F.sum(F.when(here, F.col("k")))) / 1e6, F.lit(0.0)).alias(f"sbs_{name}_ddg"))
    found = counted.groupBy("seq_id").agg(*out)
    names = [f"sbs_{n}_ddg" for n in K.SBS_CHANNELS]
    return df.select("seq_id").join(found, "seq_id", "left").fillna(0.0, names)


def sbs_spectrum(spark) -> DataFrame:
    """The 96 substitution contexts with wild-type and mutant stacking energy, from the step table."""
    rows = []
    for ref, alt in K.SBS_TYPES:
        for five in K.BASES:
            for three in K.BASES:
                wild = K.NN_DELTA_G37[five + ref] + K.NN_DELTA_G37[ref + three]
                mutant = K.NN_DELTA_G37[five + alt] + K.NN_DELTA_G37[alt + three]
                rows.append((f"{five}[{ref}>{alt}]{three}", f"{ref}>{alt}", five + ref + three, five + alt + three,
                             round(wild, 4), round(mutant, 4), round(mutant - wild, 4)))
    return spark.createDataFrame(
        rows, "channel string, mutation_type string, trinuc_ref string, trinuc_alt string, dg_wt double, "
        "dg_mut double, delta_dg double"
    )


def region_features(df: DataFrame) -> DataFrame:
    """Mean and sample sd of step properties, CpG observed/expected and step entropy (bits)."""
    seq = F.col("sequence")
    n = step_total()
    counted = _counted(df.where(F.upper("sequence").rlike("[ACGT]{2}"))).withColumns({"_c": base_count(seq, "C"), "_g": base_count(seq, "G"),
                                        "_known": F.length(clean(seq)), "gc": gc_fraction(seq)})
    second, first = step_sum(K.NN_DELTA_G37, 2), step_sum(K.NN_DELTA_G37)
    spread = F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), (second - first * first / n) / (n - 1)))).otherwise(0.0)
    product = F.col("_c").cast("double") * F.col("_g")
    entropy = reduce(
        add,
        [F.when(F.col(f"c_{d}") > 0, -(F.col(f"c_{d}") / n) * F.log2(F.col(f"c_{d}") / n)).otherwise(0.0)
         for d in K.DINUCLEOTIDES],
    )
    means = {"mean_dg37": K.NN_DELTA_G37, "mean_roll": K.ROLL, "mean_tilt": K.TILT, "mean_twist": K.TWIST,
             "mean_rise": K.RISE, "mean_deformability": K.DEFORMABILITY, "mean_a_form": K.A_FORM, "mean_z_form": K.Z_FORM}
    return counted.select(
        "seq_id", "gc", *[_mean(t).alias(k) for k, t in means.items()], spread.alias("std_dg37"),
        F.when(product > 0, F.col("c_CG") * F.col("_known") / product).otherwise(0.0).alias("cpg_obs_exp"),
        entropy.alias("dinuc_entropy"),
    )


def window_tracks(df: DataFrame, size: int = 1000) -> DataFrame:
    """The seven base tracks per window of each sequence.

    Step means come from counts; curvature and the 10.5-bp power of the AT-step
    indicator come from sums of cosines and sines over the window's steps, made
    in the kernel where the window lies; nothing is shuffled. The total power
    follows from the indicator's variance, so no transform is needed. Rows that
    share a seq_id have common sums in each window.
    """
    keyed, shared = (_track_windows(part, size) for part in _single_and_shared(df))
    single, tables = _base_tracks(keyed), _bend_tables()

    def fn(p: kernel.Pieces):
        return np.arange(len(p.begin)), kernel.window_sums(p, *tables)

    tracks = ["win", *(c for c in single.columns if c not in ("seq_id", "win", "sequence"))]
    n, zero = F.length("sequence"), F.lit(0)
    pieces = single.select("seq_id", *tracks, n.alias("n"), zero.alias("core_start"), n.alias("core_end"), zero.alias("piece_start"), F.col("sequence").alias("piece"))
    names = ("k", "dx", "dy", "sx", "re", "im", "alt")
    near = kernel.scan(pieces, fn, "m long, " + ", ".join(f"{c} double" for c in names), *tracks)
    far = _base_tracks(shared).drop("sequence").join(_shared_sums(shared), ["seq_id", "win"])
    cols = ["seq_id", *tracks]
    both = near.select(*cols, "m", *names).unionByName(far.select(*cols, F.col("m").cast("long").alias("m"), *[F.col(c).cast("double").alias(c) for c in names]))
    return both.select("seq_id", F.col("win").alias("start_pos"), *tracks[1:], *_bend_and_period())


def _track_windows(df: DataFrame, size: int) -> DataFrame:
    unknown = F.length("window") - F.length(clean(F.col("window")))
    wins = known_windows(df, size).where((F.length("window") >= 100) & (unknown <= 0.5 * F.length("window")))
    return wins.select("seq_id", F.col("start_pos").alias("win"), F.col("window").alias("sequence"))


def _base_tracks(keyed: DataFrame) -> DataFrame:
    """Windows with their text and the tracks that come from counts."""
    counted = with_step_counts(keyed.where(F.col("sequence").rlike("[ACGT]{2}")))
    gc = gc_fraction(F.col("sequence"))
    return counted.select(
        "seq_id", "win", "sequence", gc.alias("gc_content"), _mean(K.NN_DELTA_G37).alias("stacking_dg37"),
        (step_sum(K.NN_DELTA_H) * 1000.0 / step_sum(K.NN_DELTA_S) - 273.15).alias("melting_temp"),
        F.coalesce(_mean(K.MINOR_WIDTH), F.lit(5.5)).alias("groove_width"),
        ((1.0 - gc) * 3.4).alias("dipole_density"),
    )


def _shared_sums(keyed: DataFrame) -> DataFrame:
    """Sums of a window's steps with a row per step in Spark, for rows that share a seq_id: their steps lie in one window."""
    rad = math.pi / 180.0
    rows = keyed.repartition("seq_id", "win").withColumn("_bytes", F.col("sequence").cast("binary")).withColumn(
        "m", F.length("sequence") - 1
    ).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(
        "seq_id", "win", "m", F.col("_o").alias("i"), at(0, 2).alias("pair")
    ).withColumn("code", step_code(F.col("pair")))
    low = F.floor(F.col("m") / 10.5)
    near = F.when(F.abs(low / F.col("m") - 1 / 10.5) <= F.abs((low + 1) / F.col("m") - 1 / 10.5), low).otherwise(low + 1)
    order = Window.partitionBy("seq_id", "win").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns(
        {
            "x": F.when(F.col("pair").isin("AA", "TT", "AT", "TA"), 1.0).otherwise(0.0),
            "_w": 2 * math.pi * near * F.col("i") / F.col("m"),
            "_a": F.sum(F.coalesce(by_code(F.col("code"), K.TWIST), F.lit(0.0))).over(order) * rad,
            "_roll": by_code(F.col("code"), K.ROLL) * rad, "_tilt": by_code(F.col("code"), K.TILT) * rad,
        }
    )
    return marked.groupBy("seq_id", "win").agg(
        F.max("m").alias("m"), F.count("code").alias("k"),
        F.sum(F.col("_roll") * F.cos("_a") - F.col("_tilt") * F.sin("_a")).alias("dx"),
        F.sum(F.col("_roll") * F.sin("_a") + F.col("_tilt") * F.cos("_a")).alias("dy"),
        F.sum("x").alias("sx"), F.sum(F.col("x") * F.cos("_w")).alias("re"), F.sum(F.col("x") * F.sin("_w")).alias("im"),
        F.sum(F.col("x") * F.when(F.col("i") % 2 == 0, 1.0).otherwise(-1.0)).alias("alt"),
    )


def _bend_and_period() -> list[Column]:
    """Curvature and the 10.5-bp power from a window's sums."""
    rad = math.pi / 180.0
    spread = F.col("m") * (F.col("sx") - F.col("sx") * F.col("sx") / F.col("m"))
    half = F.when(F.col("m") % 2 == 0, (spread + F.col("alt") * F.col("alt")) / 2).otherwise(spread / 2)
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return [
        F.when(F.col("k") > 1, F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / F.col("k") / rad)
        .otherwise(0.0).alias("curvature"),
        F.when((F.col("m") >= 32) & (half > 1e-9), power / half).otherwise(0.0).alias("periodicity_power"),
    ]

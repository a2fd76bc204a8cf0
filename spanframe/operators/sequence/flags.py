"""Sequence evaluation: summary metrics, flags by rule, and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.seqexpr import (
    base_count,
    clean,
    gc_fraction,
    normalise,
    pair_count,
    replace_each,
    step_sum,
    step_total,
    with_step_counts,
)
from spanframe.operators.sequence import kernel, motifs, runs
from spanframe.operators.sequence.steps import CHUNK, chunks
from spanframe.operators.sequence.thermo import melting_columns, salt_delta_g, _internal_mono
from spanframe.session import written

MIN_LENGTH = 10


def validate(df: DataFrame) -> DataFrame:
    """Normal form of each sequence and, where it cannot be evaluated, the reason as ``reject``."""
    text = replace_each(F.upper("sequence"), {" ": "", "\n": "", "\r": ""})
    n = F.length("sequence")
    return df.withColumn("sequence", text).withColumn(
        "reject",
        F.when(n < MIN_LENGTH, "too_short").when(F.col("sequence").rlike("[^ACGTN]"), "invalid_characters"),
    )


def stability_windows(df: DataFrame, window: int = 100, pieces: DataFrame | None = None) -> DataFrame:
    """Mean step energy of consecutive runs of ``window`` steps (unknown bases removed first).

    ``pieces`` of ``flag_pieces`` serve the sequences without unknown bases; the others are cut after those are removed.
    """
    scaled = [round(K.NN_DELTA_G37[d] * K.STEP_SCALE) for d in K.DINUCLEOTIDES]
    # A run of `window` steps spans window+1 bases.
    scan = lambda cut: kernel.scan(cut, kernel.step_sums(window, scaled), "w int, _sum long, _steps long")
    text = normalise(F.col("sequence"))
    plain = df if pieces is None else df.where(text.contains("N"))
    sums = scan(chunks(plain.select("seq_id", clean(text).alias("sequence")), 0, window, spread=False))
    if pieces is not None:
        sums = sums.unionByName(scan(pieces.where("NOT _gaps")))
    mean = F.try_divide(F.col("_sum") / F.lit(float(K.STEP_SCALE)), F.col("_steps"))
    return sums.groupBy("seq_id", "w").agg(F.max(F.round(mean, 4)).alias("dg"))


def _flags(df: DataFrame, kinds: list[tuple[str, Column]], start, end) -> DataFrame:
    """The flags of each row, by (type, code or null), out of one reading of the rows."""
    every = F.array(*[F.struct(F.lit(kind).alias("type"), code.alias("code")) for kind, code in kinds])
    return df.select("seq_id", F.inline(F.filter(every, lambda f: f["code"].isNotNull())), start.cast("long").alias("start"), end.cast("long").alias("end"))


def _flag(df: DataFrame, kind: str, code, start, end) -> DataFrame:
    return df.select(
        "seq_id", F.lit(kind).alias("type"), (code if isinstance(code, Column) else F.lit(code)).alias("code"),
        start.cast("long").alias("start"), end.cast("long").alias("end"),
    )


def flag_pieces(plain: DataFrame, window: int = 100) -> DataFrame:
    """Sequences in normal form as pieces whose halos serve all rules of ``flags``, with the bases of their seq_id; written once."""
    total = F.sum(F.length("sequence")).over(Window.partitionBy("seq_id"))
    keyed = plain.select("seq_id", "sequence", F.when(F.col("seq_id").isNotNull(), total).alias("_total"), F.contains("sequence", F.lit("N")).alias("_gaps"))
    reach = max(K.ISLAND_LENGTH, window, K.FLAG_KMER)
    return written(chunks(keyed, max(runs.LAG.values()), reach, spread=False), "pieces")


def flags(df: DataFrame, window: int = 100, islands: DataFrame | None = None, pieces: DataFrame | None = None) -> DataFrame:
    """One row per flag: (seq_id, type, code, start, end); whole-sequence flags have null bounds.

    Sequences are cut once (``pieces`` of ``flag_pieces``), and every rule reads the pieces. Step counts that ``df`` has already are used.
    """
    counted = {f"c_{d}" for d in K.DINUCLEOTIDES} <= set(df.columns)
    plain = df.select("seq_id", normalise(F.col("sequence")).alias("sequence"))
    if pieces is None:
        plain = written(plain, "sequences")
        pieces = flag_pieces(plain, window)
    lengths = plain.select("seq_id", F.length("sequence").alias("n"))
    found = islands if islands is not None else written(motifs.island_spans(plain, pieces=pieces), "islands")
    gc = motifs.gc_windows(plain, window, pieces).withColumn("gc", F.round("gc", 4))
    start, end = F.col("start"), F.col("end")

    gc_code = F.when(F.col("gc") > K.FLAG_HIGH_GC, "HIGH_GC").when(F.col("gc") < K.FLAG_LOW_GC, "LOW_GC")
    extreme = (F.col("gc") > K.FLAG_EXTREME_HIGH) | (F.col("gc") < K.FLAG_EXTREME_LOW)
    dg = stability_windows(plain, window, pieces).join(lengths, "seq_id")
    dg_code = F.when(F.col("dg") > K.FLAG_LOW_STABILITY, "LOW_STABILITY").when(
        F.col("dg") < K.FLAG_HIGH_STABILITY, "HIGH_STABILITY"
    )
    repeated = motifs.homopolymers(plain, K.FLAG_HOMOPOLYMER, pieces=pieces)
    nothing = F.lit(None)
    # Filtering after an aggregate keeps the optimizer from copying the long count expressions.
    steps = df if counted else with_step_counts(plain.withColumn("sequence", clean(F.col("sequence"))))
    z = steps.groupBy("seq_id").agg(
        F.max(F.round(F.try_divide(step_sum(K.Z_FORM), step_total()), 3)).alias("z")
    ).where(F.col("z") < K.FLAG_Z_FORM)
    many = found.groupBy("seq_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= K.FLAG_SILENCING_ISLANDS)
    repeats = motifs.kmer_repeats(plain, K.FLAG_KMER, pieces=pieces)
    repeat_code = F.when(F.col("kind") == "direct", "DIRECT_REPEAT").otherwise("INVERTED_REPEAT")
    w_start, w_end = F.col("w") * window + 1, F.least((F.col("w") + 1) * window, F.col("n"))
    parts = [
        _flag(found, "feature", "CPG_ISLAND", F.col("start_pos") + 1, F.col("end_pos")),
        _flags(gc.where(gc_code.isNotNull() | extreme), [("info", gc_code), ("warning", F.when(extreme, "EXTREME_GC_WINDOW"))], start, end),
        _flag(dg.where(dg_code.isNotNull()), "info", dg_code, w_start, w_end),
        _flag(z, "feature", "Z_FORM_PRONE", nothing, nothing),
        _flags(repeated, [("feature", F.lit("HOMOPOLYMER")), ("feature", F.when(F.col("length") >= K.FLAG_LONG_HOMOPOLYMER, "LONG_HOMOPOLYMER"))], start, end),
        _flag(motifs.dinuc_repeats(plain, pieces=pieces), "feature", "DINUC_REPEAT", start, end),
        _flag(many, "warning", "SILENCING_RISK", nothing, nothing),
        _flag(repeats, "feature", repeat_code, F.col("first"), F.col("first") + K.FLAG_KMER - 1),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary_columns(salt_mm: float, oligo_nm: float) -> dict[str, Column]:
    """Metrics of ``sequence`` (normal form) whose N-free step counts are in scope as c_*."""
    seq, cut, n = F.col("_full"), F.col("sequence"), F.col("_n")
    steps = step_total()
    melt = melting_columns(salt_mm, oligo_nm, cut, n, F.col("_gc"))
    some = lambda c: F.when(steps > 0, c)
    return {
        "length_bp": n,
        "n_fraction": F.round(1.0 - F.try_divide(F.length(cut), n), 4),
        "gc_content": F.round("_gc", 4),
        "cpg_count": pair_count(seq, "CG"),
        "cpg_density": F.round(F.try_divide(pair_count(seq, "CG"), n), 5),
        "melting_temp": F.round(melt["melting_temp"], 1),
        "tm_method": melt["tm_method"],
        "mean_stacking_dg_salt": some(F.round(salt_delta_g(salt_mm) / steps, 3)),
        "total_stacking_dg37": some(F.round(step_sum(K.NN_DELTA_G37), 2)),
        "mean_stacking_dg37": some(F.round(F.round(step_sum(K.NN_DELTA_G37), 2) / steps, 3)),
        "mean_a_form": some(F.round(step_sum(K.A_FORM) / steps, 3)),
        "mean_z_form": some(F.round(step_sum(K.Z_FORM) / steps, 3)),
        "total_z_penalty": some(F.round(step_sum(K.Z_FORM), 2)),
        "mean_major_groove_width": some(F.round(step_sum(K.MAJOR_WIDTH) / steps, 2)),
        "mean_minor_groove_width": some(F.round(step_sum(K.MINOR_WIDTH) / steps, 2)),
        "total_extinction_260": step_sum(K.EXTINCTION) - _internal_mono(),
    }


def summarise(df: DataFrame, keys: tuple[str, ...] = ("seq_id",), salt_mm: float = 1000.0, oligo_nm: float = 250.0):
    """Count-based summary of each sequence; one pass, no shuffle. Step counts that ``df`` has already are used."""
    counted = {f"c_{d}" for d in K.DINUCLEOTIDES} <= set(df.columns)
    text = normalise(F.col("sequence"))
    staged = df.withColumn("_full", text).withColumns(
        {"_n": F.length("_full"), "_gc": gc_fraction(F.col("_full")), "sequence": clean(F.col("_full"))}
    )
    cols = summary_columns(salt_mm, oligo_nm)
    return (staged if counted else with_step_counts(staged)).select(*keys, *[c.alias(k) for k, c in cols.items()])


def evaluate(df: DataFrame, salt_mm: float = 1000.0, oligo_nm: float = 250.0, window: int = 100) -> DataFrame:
    """Full evaluation per sequence: summary, island count and flag counts by type; rejected rows keep the reason."""
    checked = written(kernel.step_counts(validate(df.select("seq_id", "sequence")), "sequence", [f"c_{d}" for d in K.DINUCLEOTIDES]), "checked")
    good = checked.where(F.col("reject").isNull()).drop("reject")
    pieces = flag_pieces(good, window)
    islands = written(motifs.island_spans(good, pieces=pieces), "islands")
    counts = flags(good, window, islands, pieces).groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n_flags"), F.count_if(F.col("type") == "warning").alias("n_warning"),
        F.count_if(F.col("type") == "feature").alias("n_feature"), F.count_if(F.col("type") == "info").alias("n_info"),
        F.count_if(F.col("code") == "CPG_ISLAND").alias("cpg_island_count"),
    )
    zero = ["n_flags", "n_warning", "n_feature", "n_info", "cpg_island_count"]
    done = summarise(good, ("seq_id",), salt_mm, oligo_nm).join(counts, "seq_id", "left").fillna(0, zero)
    return checked.select("seq_id", "reject").join(done, "seq_id", "left")


def profile_windows(df: DataFrame, window: int = 100) -> DataFrame:
    """GC and mean step energy per consecutive window."""
    gc = motifs.gc_windows(df, window).select("seq_id", "w", F.round("gc", 4).alias("gc"))
    return gc.join(stability_windows(df, window), ["seq_id", "w"], "left")


def compare(evaluations: DataFrame, baseline: DataFrame) -> DataFrame:
    """Differences of each evaluated sequence from its group's baseline.

    ``baseline`` maps ``seq_id`` to ``base_id``.
    """
    metrics = {"length_bp": "delta_length", "gc_content": "delta_gc", "cpg_island_count": "delta_cpg_islands",
               "melting_temp": "delta_melting_temp", "n_warning": "delta_warnings", "mean_stacking_dg37": "delta_mean_dg37"}
    base = evaluations.select(F.col("seq_id").alias("base_id"), *[F.col(m).alias(f"_{m}") for m in metrics])
    return (
        evaluations.join(baseline, "seq_id").where(F.col("seq_id") != F.col("base_id")).join(base, "base_id")
        .select("seq_id", "base_id", *[(F.round(F.col(m) - F.col(f"_{m}"), 4) + F.lit(0.0)).alias(d) for m, d in metrics.items()])
    )


def allele_summary(df: DataFrame, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """Stored summary of an allele's sequence, with the stepped island count."""
    text = normalise(F.col("sequence"))
    seq, n = F.col("_full"), F.col("_n")
    staged = df.withColumn("_full", text).withColumns(
        {"_n": F.length("_full"), "_gc": gc_fraction(F.col("_full")), "sequence": clean(F.col("_full"))}
    ).where((F.length("sequence") >= 2) & (F.col("_n") >= 2))
    product = base_count(seq, "C").cast("double") * base_count(seq, "G")
    steps = step_total()
    return with_step_counts(staged).select(
        *keys, F.round("_gc", 4).alias("gc_content"), pair_count(seq, "CG").alias("cpg_count"),
        F.round(pair_count(seq, "CG") / n, 5).alias("cpg_density"),
        F.round(F.when(product > 0, pair_count(seq, "CG") / (product / (n - 1))).otherwise(0.0), 4).alias("cpg_obs_exp"),
        F.round(81.5 + 41.0 * F.col("_gc") - 600.0 / n, 1).alias("melting_temp_est"),
        F.round(F.round(step_sum(K.NN_DELTA_G37), 2) / steps, 4).alias("mean_stacking_dg37"),
        F.round(step_sum(K.A_FORM) / steps, 3).alias("mean_a_form_prop"),
        F.round(step_sum(K.Z_FORM) / steps, 3).alias("mean_z_form_prop"),
        F.round(step_sum(K.Z_FORM), 2).alias("total_z_penalty"),
        F.round(step_sum(K.MAJOR_WIDTH) / steps, 2).alias("mean_major_groove_w"),
        F.round(step_sum(K.MINOR_WIDTH) / steps, 2).alias("mean_minor_groove_w"),
    )


def stepped_island_count(df: DataFrame, step: int = 10, size: int = CHUNK) -> DataFrame:
    """Runs of qualifying 200-bp windows on a coarse step, per sequence: a run is counted where it opens, inside the chunk of its first window."""
    width = K.ISLAND_LENGTH
    pieces = chunks(df.select("seq_id", "sequence"), step, width, size)
    opens = kernel.scan(pieces, runs.island_openings(width, step, K.ISLAND_GC, K.ISLAND_OE), "opens long")
    found = opens.groupBy("seq_id").agg(F.sum("opens").alias("island_count"))
    return df.select("seq_id").join(found, "seq_id", "left").fillna(0, ["island_count"])


def quick_flags(df: DataFrame) -> DataFrame:
    """Count-only flags: high or low GC, a long run, any stepped island."""
    seq = normalise(F.col("sequence"))
    gc = gc_fraction(seq)
    warn = (gc > 0.70).cast("int") + (gc < 0.30).cast("int") + seq.rlike(motifs.runs_pattern(8) + "|N{8,}").cast("int")
    counts = stepped_island_count(df)
    return df.select("seq_id", warn.alias("n_warnings")).join(counts, "seq_id").select(
        "seq_id", (F.col("n_warnings") + (F.col("island_count") > 0).cast("int")).alias("n_flags"), "n_warnings"
    )

"""Variant effects: reference and alternative window side by side, then differences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.seqexpr import STEP_SCALE, normalise, pair_count, step_sum, step_total, with_step_counts
from spanframe.operators.sequence import kernel
from spanframe.operators.sequence.motifs import G4, runs_pattern
from spanframe.operators.sequence.steps import CHUNK, chunks
from spanframe.operators.sequence.thermo import GROOVES, STRUCTURE, curvature
from spanframe.session import scratch_dir

#: Lags of the autocorrelation of AT steps, about a helix turn.
LAGS = (10, 11)


def _cells(sequences: DataFrame, size: int) -> DataFrame:
    """(seq_id, cell, at, part): text on one grid of ``size`` bases, of whole sequences or of a table that comes as chunks of any grid."""
    if not {"chunk", "start_pos"} <= set(sequences.columns):
        whole = chunks(sequences.select("seq_id", "sequence"), size=size, spread=False)
        return whole.select("seq_id", F.col("chunk").cast("long").alias("cell"), F.col("core_start").cast("long").alias("at"), F.col("piece").alias("part"))
    begin, end = F.col("start_pos").cast("long"), F.col("start_pos") + F.length("_raw")
    cut = sequences.where(F.length("sequence") > 0).select("seq_id", "start_pos", normalise(F.col("sequence")).cast("binary").alias("_raw"))
    cut = cut.withColumn("cell", F.explode(F.sequence(F.floor(begin / size), F.floor((end - 1) / size))))
    low = F.greatest(F.col("cell") * size, begin)
    return cut.select("seq_id", "cell", low.alias("at"), F.substring("_raw", (low - begin + 1).cast("int"), F.lit(size)).cast("string").alias("part")).select(
        "seq_id", "cell", "at", F.substring("part", F.lit(1), ((F.col("cell") + 1) * size - F.col("at")).cast("int")).alias("part"))


def read_spans(spans: DataFrame, sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """Text of each distinct span (seq_id, low, high), cut at the sequence's end; spans without a base have no row.

    Spans meet the cells of a grid, one or two each if they are short, and parts are put together behind the join, so a row never holds more of a
    sequence than its span.
    """
    cells = F.sequence(F.floor(F.col("low") / size), F.floor((F.col("high") - 1) / size))
    wanted = spans.where("low >= 0 AND high > low").select("seq_id", "low", "high").distinct().withColumn("cell", F.explode(cells))
    begin = F.greatest(F.col("low"), F.col("at"))
    taken = F.substring("part", (begin - F.col("at") + 1).cast("int"), (F.col("high") - begin).cast("int"))
    parts = wanted.join(_cells(sequences, size), ["seq_id", "cell"]).select("seq_id", "low", "high", F.struct(begin.alias("at"), taken.alias("part")).alias("_p"))
    glued = F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda x: x["part"]), "")
    return parts.where(F.length("_p.part") > 0).groupBy("seq_id", "low", "high").agg(glued.alias("text"))


def apply_variants(variants: DataFrame, sequences: DataFrame, flank: int = 50, size: int = CHUNK) -> DataFrame:
    """Window of ``flank`` bases on both sides, as reference and alternative text.

    ``variants``: variant_id, seq_id, pos (0-based), ref, alt. A reference that
    does not match the sequence, also one beyond its end or on no known sequence,
    gives ``reject`` and null texts. ``sequences`` are whole or come as chunks.
    """
    low = F.greatest(F.lit(0), F.col("pos") - flank).cast("long")
    placed = variants.withColumns({"low": low, "high": (F.col("pos") + F.length("ref") + flank).cast("long")})
    joined = placed.join(read_spans(placed, sequences, size), ["seq_id", "low", "high"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    at, span = (F.col("pos") - F.col("low")).cast("int"), F.length("ref")
    head, tail = F.substring("text", F.lit(1), at), F.substring("text", at + span + 1, F.lit(flank))
    seen = (F.substring("text", at + 1, span) == F.upper("ref")) & (F.col("pos") >= 0) & (F.length("text") >= at)
    ok = F.coalesce(seen & F.col("alt").isNotNull(), F.lit(False))
    return joined.select(
        "variant_id", "seq_id", "pos", "ref", "alt", F.when(~ok, "reference_mismatch").alias("reject"),
        at.alias("at"), F.when(ok, F.concat(head, F.upper("ref"), tail)).alias("ref_seq"),
        F.when(ok, F.concat(head, F.upper("alt"), tail)).alias("alt_seq"),
    )


def _lagged(p: kernel.Pieces):
    """Per piece: AT steps, and for each lag the pairs of steps, AT steps on both sides and their products. Whole numbers, so pieces add up exactly."""
    code = p.ahead(p.code, 4)
    weak = (code == 0) | (code == 3)
    x = (weak[:-1] & weak[1:]).astype(np.int64)
    at, count = p.core(2), len(p.begin)
    made = {"hits": np.bincount(p.piece[at], x[at], count).astype(np.int64)}
    for lag in LAGS:
        now = at[p.i[at] >= lag]
        which, a, b = p.piece[now], x[now], x[now - lag]
        for name, v in (("n", np.ones(len(now))), ("x", a), ("y", b), ("xy", a * b)):
            made[f"{name}{lag}"] = np.bincount(which, v, count).astype(np.int64)
    return np.arange(count), made


def _periodicity(both: DataFrame) -> DataFrame:
    """Mean of the 10- and 11-step autocorrelations of the AT-step indicator, per window of at least 23 bases with two such steps."""
    names = ["hits", *(f"{v}{lag}" for lag in LAGS for v in ("n", "x", "y", "xy"))]
    pieces = chunks(both.select(F.struct("variant_id", "allele").alias("seq_id"), "sequence"), max(LAGS), 1, spread=False)
    sums = kernel.scan(pieces, _lagged, ", ".join(f"{c} long" for c in names), "n").groupBy("seq_id", "n").agg(*[F.sum(c).alias(c) for c in names])

    def corr(lag: int) -> Column:
        n, x, y, xy = (F.col(f"{v}{lag}").cast("double") for v in ("n", "x", "y", "xy"))
        return F.coalesce(F.try_divide(n * xy - x * y, F.sqrt((n * x - x * x) * (n * y - y * y))), F.lit(0.0))

    mean = sum((corr(lag) for lag in LAGS), F.lit(0.0)) / len(LAGS)
    return sums.where("n >= 23").select("seq_id.variant_id", "seq_id.allele", F.when(F.col("hits") >= 2, mean).otherwise(0.0).alias("periodicity"))


def _step_mean(table: dict[str, float]) -> Column:
    """Mean of a step property to three places, half away from zero. In whole numbers: means over about 100 steps often lie on a tie."""
    total, n = F.round(step_sum(table) * STEP_SCALE).cast("long"), step_total()
    thousandths = F.floor(F.try_divide(2 * (1000 // STEP_SCALE) * F.abs(total) + n, 2 * n))
    return F.signum(total.cast("double")) * thousandths / 1000.0


def variant_deltas(variants: DataFrame, sequences: DataFrame, flank: int = 50) -> DataFrame:
    """Differences alternative minus reference: energy, structure, curvature, grooves, motifs, CpG, periodicity.

    Both texts of a variant go through the same operators as one stacked table.
    The short windows are written once, because four branches read them: the
    sequences are cut and shuffled for them once, not four times.
    """
    spark, path = variants.sparkSession, scratch_dir(variants.sparkSession, "windows")
    asked = apply_variants(variants, sequences, flank)
    asked.write.parquet(path)
    windows = spark.read.schema(asked.schema).parquet(path)
    good = windows.where(F.col("reject").isNull())
    both = good.select(
        "variant_id", "at",
        F.inline(F.array(F.struct(F.lit("ref").alias("allele"), F.col("ref_seq").alias("sequence")),
                         F.struct(F.lit("alt").alias("allele"), F.col("alt_seq").alias("sequence")))),
    )
    steps = step_total()
    text = F.col("sequence")
    tables = {f"mean_{p}": K.STEP_PROPERTIES[p] for p in (*STRUCTURE, *GROOVES)}
    here = (
        (F.substring(text, F.col("at"), F.lit(2)) == "CG").cast("int") * (F.col("at") > 0).cast("int")
        + (F.substring(text, F.col("at") + 1, F.lit(2)) == "CG").cast("int")
    )
    counted = with_step_counts(both).select(
        "variant_id", "allele",
        F.round(step_sum(K.NN_DELTA_G37), 2).alias("dg37"), F.round(step_sum(K.NN_DELTA_H), 2).alias("dh"),
        F.round(step_sum(K.NN_DELTA_S), 2).alias("ds"),
        F.round((step_sum(K.NN_DELTA_H) - K.KELVIN_37 * step_sum(K.NN_DELTA_S) / 1000.0) / steps, 3).alias("mean_dg"),
        *[_step_mean(t).alias(k) for k, t in tables.items()],
        F.regexp_count(text, F.lit(G4)).alias("g4"), F.regexp_count(text, F.lit(runs_pattern(5))).alias("runs"),
        here.alias("cpg_here"), pair_count(text, "CG").alias("cpg_all"),
    )
    bent = curvature(both.select(F.struct("variant_id", "allele").alias("seq_id"), "sequence")).select(
        "seq_id.variant_id", "seq_id.allele", "mean_curvature", "max_curvature")
    full = counted.join(bent, ["variant_id", "allele"]).join(_periodicity(both), ["variant_id", "allele"], "left")
    values = [c for c in full.columns if c not in ("variant_id", "allele")]
    pick = lambda c, a: F.max(F.when(F.col("allele") == a, F.col(c)))
    wide = full.fillna(0.0, ["periodicity"]).groupBy("variant_id").agg(
        *[(F.round(pick(c, "alt") - pick(c, "ref"), 4) + F.lit(0.0)).alias(f"delta_{c}") for c in values]
    )
    cpg = F.col("delta_cpg_here")
    nuc = F.col("delta_periodicity")
    out = wide.withColumns(
        {
            "delta_tm": F.round(F.col("delta_mean_dg") * 3.0, 4) + F.lit(0.0),
            "cpg_impact": F.when(cpg > 0, "cpg_created").when(cpg < 0, "cpg_destroyed").otherwise("no_change"),
            "nucleosome": F.when(nuc < -0.05, "nucleosome_destabilized").when(nuc > 0.05, "nucleosome_stabilized")
            .otherwise("minimal_disruption"),
        }
    )
    return windows.select("variant_id", "seq_id", "pos", "ref", "alt", "reject").join(out, "variant_id", "left")


def mechanisms(deltas: DataFrame) -> DataFrame:
    """Short statements per variant, from fixed thresholds on its differences."""
    dg, tm, twist = F.col("delta_dg37"), F.col("delta_tm"), F.col("delta_mean_twist")
    said = F.array_compact(F.array(
        F.when(dg > 0.5, "destabilizes local duplex").when(dg < -0.5, "stabilizes local duplex"),
        F.when(tm > 1.0, "raises melting temperature").when(tm < -1.0, "lowers melting temperature"),
        F.when(F.col("cpg_impact") != "no_change", F.col("cpg_impact")),
        F.when(F.col("delta_g4") > 0, "g_quadruplex created").when(F.col("delta_g4") < 0, "g_quadruplex destroyed"),
        F.when(F.col("nucleosome") != "minimal_disruption", F.col("nucleosome")),
        F.when(F.abs(twist) > 0.5, "alters helical twist"),
    ))
    return deltas.withColumn("mechanism", F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("minimal perturbation"))))

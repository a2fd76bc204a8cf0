"""Multi-part constructs: junctions, assembly flags and summaries.

``parts``: construct_id, part_no (0..n-1, at most 20 per construct), sequence,
circular. Every check is a table job over all constructs at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.seqexpr import gc_count, normalise
from spanframe.operators.sequence import kernel, motifs
from spanframe.operators.sequence.steps import chunks

FLANK = 25
JUNCTION_RUN = 7
SHARED_K = 13
GC_LOW, GC_HIGH = 0.25, 0.75


def _keyed(parts: DataFrame) -> DataFrame:
    """Parts as sequences with a text id that carries construct and part."""
    return parts.select(
        F.concat_ws(":", "construct_id", "part_no").alias("seq_id"), "construct_id", "part_no",
        normalise(F.col("sequence")).alias("sequence"), "circular",
    )


def junctions(parts: DataFrame) -> DataFrame:
    """Last and first 25 bases around every part boundary, plus the closing one of circular constructs."""
    plain = _keyed(parts)
    ends = plain.select(
        "construct_id", "part_no", "circular", F.substring("sequence", 1, FLANK).alias("_head"),
        F.expr(f"right(sequence, {FLANK})").alias("_tail"),
    )
    order = Window.partitionBy("construct_id").orderBy("part_no")
    whole = Window.partitionBy("construct_id")
    near = ends.withColumns(
        {
            "_next": F.lead("part_no").over(order), "_next_head": F.lead("_head").over(order),
            "_first": F.min("part_no").over(whole), "_n": F.count(F.lit(1)).over(whole),
            "_first_head": F.min_by("_head", "part_no").over(whole),
        }
    )
    closing = F.col("_next").isNull() & F.col("circular") & (F.col("_n") > 1)
    return near.where(F.col("_next").isNotNull() | closing).select(
        "construct_id", F.col("part_no").alias("left_part"), F.coalesce("_next", "_first").alias("right_part"),
        F.concat("_tail", F.coalesce("_next_head", "_first_head")).alias("sequence"),
    )


def shared_kmers(parts: DataFrame, k: int = SHARED_K) -> DataFrame:
    """k-mers shared by two parts of a construct, with the first place in each.

    The parts of a construct meet as text, in buckets of bounded size; only the
    shared k-mers leave the kernel.
    """
    plain = _keyed(parts).where("construct_id IS NOT NULL AND part_no IS NOT NULL")
    total = F.sum(F.length("sequence")).over(Window.partitionBy("construct_id"))
    keyed = plain.select("seq_id", "construct_id", F.col("part_no").cast("long").alias("part_no"), "sequence", total.alias("_total"))
    pieces = chunks(keyed, 0, k - 1, spread=False)
    shared = kernel.by_kmer(
        pieces, "construct_id", "_total", k, kernel.forward_kmers(k), kernel.shared_places,
        "kmer long, part_a long, position_a long, part_b long, position_b long", "part_no")
    kind = plain.schema["part_no"].dataType
    return shared.select(
        "construct_id", motifs.spelled(F.col("kmer"), k).alias("kmer"), F.col("part_a").cast(kind).alias("part_a"), F.col("position_a").cast("int").alias("position_a"),
        F.col("part_b").cast(kind).alias("part_b"), F.col("position_b").cast("int").alias("position_b"))


def construct_flags(parts: DataFrame) -> DataFrame:
    """Assembly flags: internal restriction sites, junction runs, shared k-mers, extreme GC windows."""
    plain = _keyed(parts)
    ids = plain.select("seq_id", "construct_id", "part_no")
    sites = motifs.restriction_sites(plain.select("seq_id", "sequence")).join(ids, "seq_id").select(
        "construct_id", F.lit("INTERNAL_RESTRICTION_SITE").alias("code"), "part_no", F.col("enzyme").alias("detail"),
        F.col("position").cast("long").alias("position"),
    )
    joints = junctions(parts).select(
        F.concat_ws(":", "construct_id", "left_part").alias("seq_id"), "construct_id",
        F.col("left_part").alias("part_no"), "sequence",
    )
    runs = motifs.homopolymers(joints, JUNCTION_RUN).join(joints.drop("sequence"), "seq_id").select(
        "construct_id", F.lit("JUNCTION_HOMOPOLYMER").alias("code"), "part_no",
        F.concat(F.col("base"), F.lit("x"), F.col("length")).alias("detail"), F.col("start").cast("long").alias("position"),
    )
    shared = shared_kmers(parts).select(
        "construct_id", F.lit("CROSS_PART_REPEAT").alias("code"), F.col("part_a").alias("part_no"),
        F.concat(F.col("kmer"), F.lit("@"), F.col("part_b")).alias("detail"), F.col("position_a").cast("long").alias("position"),
    )
    offsets = plain.select("seq_id", "construct_id", "part_no", F.length("sequence").alias("_n")).withColumn(
        "_offset", F.coalesce(F.sum("_n").over(
            Window.partitionBy("construct_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    gc = motifs.gc_windows(plain.select("seq_id", "sequence"), 100).where(
        (F.col("gc") < GC_LOW) | (F.col("gc") > GC_HIGH)
    ).join(offsets, "seq_id").select(
        "construct_id", F.lit("EXTREME_GC_WINDOW").alias("code"), "part_no",
        F.when(F.col("gc") < GC_LOW, "low").otherwise("high").alias("detail"),
        (F.col("_offset") + F.col("start")).cast("long").alias("position"),
    )
    return sites.unionByName(runs).unionByName(shared).unionByName(gc)


def construct_report(parts: DataFrame) -> DataFrame:
    """One row per construct: length, GC, parts, junctions and assembly flags."""
    plain = _keyed(parts)
    seq = F.col("sequence")
    gc = gc_count(seq)
    known = F.length(F.replace(seq, F.lit("N"), F.lit("")))
    base = plain.groupBy("construct_id").agg(
        F.sum(F.length(seq)).alias("total_length_bp"), F.count(F.lit(1)).alias("n_parts"),
        (F.sum(gc) / F.sum(known)).alias("gc_content"), F.max("circular").alias("circular"),
    )
    joined = base.withColumn(
        "n_junctions", F.col("n_parts") - 1 + F.when(F.col("circular") & (F.col("n_parts") > 1), 1).otherwise(0)
    )
    flags = construct_flags(parts).groupBy("construct_id").agg(F.count(F.lit(1)).alias("n_assembly_flags"))
    return joined.join(flags, "construct_id", "left").fillna(0, ["n_assembly_flags"])


def compare_constructs(report: DataFrame, baseline: DataFrame) -> DataFrame:
    """Differences of each construct from its baseline (construct_id, base_id)."""
    metrics = ("total_length_bp", "gc_content", "n_assembly_flags")
    base = report.select(F.col("construct_id").alias("base_id"), *[F.col(m).alias(f"_{m}") for m in metrics])
    return report.join(baseline, "construct_id").where(F.col("construct_id") != F.col("base_id")).join(base, "base_id").select(
        "construct_id", "base_id", *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in metrics]
    )



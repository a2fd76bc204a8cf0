"""Probe tables: windows of probes, cross-platform maps, clocks and repeat-family risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions.classify import risk_level
from spanframe.functions.coords import bin_start
from spanframe.operators.overlap import KEYS
from spanframe.operators.topk import method_priority, top_k_per_group


def attach_window(points: DataFrame, windows: DataFrame, identity: Sequence[str], size: int = 1000) -> DataFrame:
    """Each id (its first place by chromosome and position) with the window containing it; left equi-join."""
    first = top_k_per_group(points, identity, [F.col("chr_id"), F.col("pos")], 1)
    placed = first.withColumn("start_pos", bin_start(F.col("pos"), size))
    return placed.join(windows, [*KEYS, "start_pos"], "left")


def cross_map(probes: DataFrame) -> DataFrame:
    """Directed edges between platforms: same id (exact_id), else same place (coord_overlap), in both directions.

    Of several probes of a platform at one place, the last (largest row id)
    stands for it on the source side.
    """
    base = probes.select("platform", "probe_id", "build", "chr_id", "pos", "row_id")
    by_id = top_k_per_group(base, ["platform", "probe_id"], [F.col("row_id").desc()], 1)
    dst = by_id.select(*[F.col(c).alias(f"d_{c}") for c in by_id.columns])
    same = by_id.join(
        dst, (F.col("probe_id") == F.col("d_probe_id")) & (F.col("platform") < F.col("d_platform"))
    ).withColumn("method", F.lit("exact_id"))
    by_place = top_k_per_group(base, ["platform", "chr_id", "pos"], [F.col("row_id").desc()], 1)
    near = by_place.join(
        dst, (F.col("chr_id") == F.col("d_chr_id")) & (F.col("pos") == F.col("d_pos"))
        & (F.col("platform") < F.col("d_platform")) & (F.col("probe_id") != F.col("d_probe_id")),
    ).withColumn("method", F.lit("coord_overlap"))
    pairs = same.unionByName(near)
    forward = pairs.select(
        F.col("platform").alias("src_platform"), F.col("probe_id").alias("src_probe_id"),
        F.col("d_platform").alias("dst_platform"), F.col("d_probe_id").alias("dst_probe_id"),
        "build", "chr_id", "pos", "method", F.lit(1.0).alias("confidence"),
    )
    backward = pairs.select(
        F.col("d_platform").alias("src_platform"), F.col("d_probe_id").alias("src_probe_id"),
        F.col("platform").alias("dst_platform"), F.col("probe_id").alias("dst_probe_id"),
        F.col("d_build").alias("build"), F.col("d_chr_id").alias("chr_id"), F.col("d_pos").alias("pos"), "method",
        F.lit(1.0).alias("confidence"),
    )
    return forward.unionByName(backward)


def crossmap_of(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the given source ids, one per destination, best method first."""
    mine = edges.join(ids.select(F.col("probe_id").alias("src_probe_id")).distinct(), "src_probe_id")
    order = [method_priority(F.col("method")), F.col("src_platform"), F.col("chr_id"), F.col("pos")]
    return top_k_per_group(mine, ["src_probe_id", "dst_platform", "dst_probe_id"], order, 1)


def filter_probes(
    probes: DataFrame, detection: DataFrame, snp: DataFrame, cross_reactive: DataFrame, threshold: float = 0.01
) -> tuple[DataFrame, DataFrame]:
    """Quality filter: (kept probes, removed count per first failing reason).

    Reasons apply in order: detection p above the threshold in any sample, SNP
    probe, sex chromosome (ids 23, 24), cross-reactive probe.
    """
    failed = detection.where(F.col("p_value") > threshold).select("probe_id").distinct().withColumn("_det", F.lit(True))
    marked = (
        probes.join(failed, "probe_id", "left")
        .join(snp.select("probe_id").distinct().withColumn("_snp", F.lit(True)), "probe_id", "left")
        .join(cross_reactive.select("probe_id").distinct().withColumn("_cross", F.lit(True)), "probe_id", "left")
    )
    reason = (
        F.when(F.col("_det"), "detection").when(F.col("_snp"), "snp").when(F.col("chr_id").isin(23, 24), "sex_chromosome")
        .when(F.col("_cross"), "cross_reactive")
    )
    judged = marked.withColumn("reason", reason).drop("_det", "_snp", "_cross")
    kept = judged.where(F.col("reason").isNull()).drop("reason")
    return kept, judged.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def id_lookup(ids: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(resolved rows, unresolved ids) of a requested id list."""
    wanted = ids.select(key).distinct()
    return table.join(wanted, key), wanted.join(table.select(key), key, "left_anti")


def clock_summary(clocks: DataFrame, places: DataFrame, windows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per clock: probes, and mean, sd and |coefficient|-weighted mean of window columns at its probes."""
    located = attach_window(places, windows, ["probe_id"])
    joined = clocks.join(located.select("probe_id", *columns), "probe_id", "left")
    weight = F.abs("coef")
    aggs = []
    for c in columns:
        known = F.when(F.col(c).isNotNull(), weight)
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"),
                 F.try_divide(F.sum(weight * F.col(c)), F.sum(known)).alias(f"wmean_{c}")]
    return joined.groupBy("clock").agg(F.count(F.lit(1)).alias("n_probes"), *aggs)


def clock_contexts(clocks: DataFrame, context: str = "cpg_context") -> DataFrame:
    """Probes of each clock by site context, a missing context as ``unknown``."""
    return clocks.groupBy("clock", F.coalesce(context, F.lit("unknown")).alias("context")).agg(F.count(F.lit(1)).alias("n_probes"))


def clock_compare(a: DataFrame, b: DataFrame, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two clocks: shared and unique probes, Jaccard, and mean differences (b minus a) of window columns."""
    left = a.select("probe_id").distinct().withColumn("_a", F.lit(1))
    right = b.select("probe_id").distinct().withColumn("_b", F.lit(1))
    both = left.join(right, "probe_id", "full").join(values, "probe_id", "left")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(
        F.count_if(in_a & in_b).alias("shared"), F.count_if(in_a & ~in_b).alias("unique_a"), F.count_if(~in_a & in_b).alias("unique_b"),
        (F.count_if(in_a & in_b) / F.count(F.lit(1))).alias("jaccard"),
        *[(F.avg(F.when(in_b, F.col(c))) - F.avg(F.when(in_a, F.col(c)))).alias(f"delta_{c}") for c in columns],
    )


def clock_predict(betas: DataFrame, coefficients: DataFrame, intercepts: DataFrame, ages: DataFrame | None = None) -> DataFrame:
    """Predicted age per sample and clock, probes used, coverage, and acceleration where the age is known."""
    totals = coefficients.groupBy("clock").agg(F.count(F.lit(1)).alias("n_total"))
    out = (
        betas.join(coefficients, "probe_id").groupBy("sample", "clock")
        .agg(F.sum(F.col("beta") * F.col("coef")).alias("_sum"), F.count(F.lit(1)).alias("n_used"))
        .join(totals, "clock").join(intercepts, "clock")
        .select("sample", "clock", (F.col("intercept") + F.col("_sum")).alias("age"), "n_used",
                (F.col("n_used") / F.col("n_total")).alias("coverage"))
    )
    if ages is None:
        return out
    return out.join(ages, "sample", "left").withColumn("acceleration", F.col("age") - F.col("chronological_age"))


def family_risk(betas: DataFrame, membership: DataFrame, families: DataFrame) -> DataFrame:
    """Per sample and repeat family: mean beta, coverage, shift from the reference midpoint and risk level.

    ``families``: family, ref_low, ref_high, score.
    """
    totals = membership.groupBy("family").agg(F.count(F.lit(1)).alias("n_total"))
    mid = (F.col("ref_low") + F.col("ref_high")) / 2
    out = (
        betas.join(membership, "probe_id").groupBy("sample", "family")
        .agg(F.avg("beta").alias("mean_beta"), F.count(F.lit(1)).alias("n_probes"))
        .join(totals, "family").join(families, "family").withColumn("_mid", mid)
    )
    risk = F.round(F.col("score") * F.greatest(F.lit(0.0), (F.col("_mid") - F.col("mean_beta")) / F.col("_mid")), 3)
    return out.withColumns(
        {"coverage": F.col("n_probes") / F.col("n_total"), "delta": F.col("mean_beta") - F.col("_mid"), "risk": risk}
    ).withColumn("level", risk_level(F.col("risk"))).drop("_mid", "score", "ref_low", "ref_high")


def platform_coverage(xref: DataFrame) -> DataFrame:
    """Probes per repeat family and platform, long form."""
    return xref.groupBy("family", "platform").agg(F.count_distinct("probe_id").alias("n_probes"))


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union of two id sets with membership: shared, only_a or only_b."""
    left = a.select(key).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).distinct().withColumn("_b", F.lit(1))
    member = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("shared")
    return left.join(right, key, "full").select(key, member.alias("member"))

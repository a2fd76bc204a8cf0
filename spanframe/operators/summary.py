"""Layer, repeat-family, allele and cell-type summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.classify import reactivation_contexts, reactivation_score, silencing
from spanframe.operators.scan import exact_quantiles
from spanframe.operators.topk import top_k_per_group


def layer_summary(layers: DataFrame, dimensions: Sequence[str] = ("genome_build", "layer_type", "evidence_class")) -> DataFrame:
    """Counts of layers and rows overall and by each dimension, in one grouping-sets style pass."""
    cells = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions],
    )
    return layers.select("layer_type", "row_count", F.inline(cells)).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n_layers"), F.sum("row_count").alias("n_rows"), F.count_distinct("layer_type").alias("n_types")
    )


def platform_summary(layers: DataFrame) -> DataFrame:
    """One row over the active default layers: layers, layer types, builds and rows."""
    return layers.where(F.col("is_active") & F.col("is_default")).agg(
        F.count(F.lit(1)).alias("total_layers"), F.count_distinct("layer_type").alias("distinct_layer_types"),
        F.count_distinct("genome_build").alias("supported_builds"), F.sum("row_count").alias("total_rows"),
    )


def family_summary(repeats: DataFrame) -> DataFrame:
    """Per class and family: copies, base pairs, mean divergence (2 places), median length."""
    key = ["repeat_class", "repeat_family"]
    sized = repeats.withColumn("_len", (F.col("end_pos") - F.col("start_pos")).cast("double"))
    base = sized.groupBy(*key).agg(
        F.count(F.lit(1)).alias("copy_count"), F.sum(F.col("_len").cast("long")).alias("total_bp"),
        F.round(F.avg("divergence_pct"), 2).alias("avg_divergence"),
    )
    return base.join(exact_quantiles(sized, key, "_len", {"median_length": 0.5}), key)


def family_probe_counts(xref: DataFrame, platforms: Sequence[str]) -> DataFrame:
    return xref.groupBy("repeat_class", "repeat_family").agg(
        *[F.count_if(F.col("platform") == p).alias(f"{p}_probes") for p in platforms]
    )


def family_chr_density(repeats: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Base pairs per kb of chromosome for every family."""
    sums = repeats.groupBy("repeat_class", "repeat_family", "chr_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("_bp"))
    return sums.join(chromosomes, "chr_id").select(
        "repeat_class", "repeat_family", "chr_id", F.round(F.try_divide(F.col("_bp"), F.col("length")) * 1000, 3).alias("density")
    )


def family_scores(summary: DataFrame, probe_counts: DataFrame) -> DataFrame:
    """Families with probe counts, reactivation score, silencing heuristic and contexts."""
    joined = summary.join(probe_counts, ["repeat_class", "repeat_family"], "left").fillna(0)
    cls, div = F.col("repeat_class"), F.col("avg_divergence")
    return joined.withColumns(
        {"reactivation_score": F.round(reactivation_score(cls, div), 3), "silencing": silencing(cls)["primary"],
         "silencing_confidence": silencing(cls)["confidence"], "contexts": reactivation_contexts(cls, F.col("repeat_family"))}
    )


def loci_from_fragments(fragments: DataFrame, locus: str = "locus") -> DataFrame:
    """Locus bounds, fragment count and length from fragment rows."""
    return fragments.groupBy("build", "chr_id", locus).agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n_fragments"),
        (F.max("end_pos") - F.min("start_pos")).alias("locus_length"),
    )


def locus_summary(alleles: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Alleles per locus, with genomic sequence, with suffix, and metric means over the genomic ones."""
    genomic = F.col("has_genomic")
    return alleles.groupBy("locus").agg(
        F.count(F.lit(1)).alias("n_alleles"), F.count_if(genomic).alias("n_genomic"),
        F.count_if(F.col("suffix").isNotNull()).alias("n_suffixed"), F.count_distinct("protein").alias("n_proteins"),
        *[F.avg(F.when(genomic, F.col(m))).alias(f"mean_{m}") for m in metrics],
    )


def allele_list(alleles: DataFrame, filters: dict, limit: int, offset: int = 0) -> DataFrame:
    """Filtered page of alleles in name order."""
    out = alleles
    for field, value in filters.items():
        out = out.where(F.col(field) == value)
    return out.orderBy("allele_name").offset(offset).limit(limit)


def pair_delta(pairs: DataFrame, table: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Other minus reference for each pair (ref_id, other_id) and metric, 6 places; null where either side is."""
    ref = table.select(F.col(key).alias("ref_id"), *[F.col(m).alias(f"_r_{m}") for m in metrics])
    other = table.select(F.col(key).alias("other_id"), *[F.col(m).alias(f"_o_{m}") for m in metrics])
    both = pairs.join(ref, "ref_id").join(other, "other_id")
    return both.select(*pairs.columns, *[(F.round(F.col(f"_o_{m}") - F.col(f"_r_{m}"), 6) + F.lit(0.0)).alias(f"delta_{m}") for m in metrics])


def match_score(pairs: DataFrame, alleles: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Donor-recipient match per case and locus.

    ``pairs``: case_id, locus, role (donor/recipient), allele_id (two per role).
    Protein sets are compared, and absolute metric differences averaged over the
    four donor-recipient pairs, then summed over metrics.
    """
    named = pairs.join(alleles.select("allele_id", "allele_group", "protein", *metrics), "allele_id")
    donor = named.where(F.col("role") == "donor").drop("role", "allele_id")
    recipient = named.where(F.col("role") == "recipient").select(
        "case_id", "locus", F.col("allele_group").alias("_rg"), F.col("protein").alias("_rp"), *[F.col(m).alias(f"_r_{m}") for m in metrics]
    )
    both = donor.join(recipient, ["case_id", "locus"])
    gap = sum((F.coalesce(F.avg(F.abs(F.col(m) - F.col(f"_r_{m}"))), F.lit(0.0)) for m in metrics), F.lit(0.0))
    return both.groupBy("case_id", "locus").agg(
        (F.sort_array(F.collect_set(F.concat_ws(":", "allele_group", "protein")))
         == F.sort_array(F.collect_set(F.concat_ws(":", "_rg", "_rp")))).alias("protein_match"),
        gap.alias("divergence"),
    )


def collapse_donors(matrix: DataFrame, groups: DataFrame, fun: str = "mean") -> DataFrame:
    """feature x sample to feature x bucket by mean or exact median; samples without a bucket drop out."""
    joined = matrix.where(F.col("value").isNotNull()).join(groups, "sample")
    if fun == "median":
        return exact_quantiles(joined, ["feature", "bucket"], "value", {"value_out": 0.5}, buckets=64)
    return joined.groupBy("feature", "bucket").agg(F.avg("value").alias("value_out"))


def shannon_entropy(long: DataFrame, keys: Sequence[str], value: str, normalised: bool = True) -> DataFrame:
    """Entropy of positive values per key: over log of their number, or in nats. One positive value gives 0.

    H = ln S - sum(v ln v)/S, so one pass of sums is enough.
    """
    v = F.when(F.col(value) > 0, F.col(value))
    sums = long.groupBy(*keys).agg(F.count(v).alias("_k"), F.sum(v).alias("_s"), F.sum(v * F.log(v)).alias("_sl"))
    nats = F.log("_s") - F.col("_sl") / F.col("_s")
    value_out = nats / F.log("_k") if normalised else nats
    return sums.select(*keys, F.when(F.col("_k") > 1, value_out).otherwise(0.0).alias("entropy"))


def edge_change(edges: DataFrame, matrix: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """Per graph edge: number of features changing by more than ``threshold``, and the top ``k`` by change."""
    a = matrix.select(F.col("bucket").alias("from_node"), "feature", F.col("value").alias("_a"))
    b = matrix.select(F.col("bucket").alias("to_node"), "feature", F.col("value").alias("_b"))
    both = edges.join(a, "from_node").join(b, ["to_node", "feature"]).withColumn("delta", F.abs(F.col("_a") - F.col("_b")))
    changed = both.where(F.col("delta") > threshold)
    counts = edges.join(changed.groupBy("from_node", "to_node").agg(F.count(F.lit(1)).alias("n_changed")),
                        ["from_node", "to_node"], "left").fillna(0, ["n_changed"])
    top = top_k_per_group(changed, ["from_node", "to_node"], [F.col("delta").desc(), "feature"], k, "rank")
    return counts, top.select("from_node", "to_node", "feature", "delta", "rank")


def row_zscore(matrix: DataFrame, feature: str = "feature", value: str = "value", out: str = "z") -> DataFrame:
    """Scale each feature over its samples; features without variance give null."""
    stats = matrix.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return matrix.join(stats, feature).withColumn(
        out, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))
    ).drop("_m", "_s")


def allele_feature_summary(features: DataFrame, metrics: Sequence[str], noncoding: Column) -> DataFrame:
    """Whole and non-coding metric means per allele over its feature rows."""
    return features.groupBy("allele_id").agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(noncoding).alias("n_noncoding"),
        *[F.avg(m).alias(f"whole_{m}") for m in metrics],
        *[F.avg(F.when(noncoding, F.col(m))).alias(f"nc_{m}") for m in metrics],
    )



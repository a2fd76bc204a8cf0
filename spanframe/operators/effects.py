"""Group effects, distributions, differential methylation, similarity and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.classify import cohens_d
from spanframe.functions.pvalues import p_value_t
from spanframe.operators.scan import exact_quantiles, value_ranks
from spanframe.operators.similarity import most_similar
from spanframe.operators.topk import global_top_k


def unpivot(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form: keys, metric, value; nulls dropped."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.inline(cells)).where(F.col("value").isNotNull())


def distribution(df: DataFrame, metrics: Sequence[str], bins: int = 30) -> DataFrame:
    """Per metric: count, range, mean, percentiles and a closed-end histogram (array of bin counts)."""
    long = unpivot(df, [], metrics)
    # Reported percentiles.
    probs = {"p5": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}
    base = long.groupBy("metric").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )
    lo, hi = F.col("min"), F.col("max")
    spot = F.when(hi > lo, F.least(F.floor((F.col("value") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).otherwise(0)
    counts = long.join(base.select("metric", "min", "max"), "metric").groupBy("metric", spot.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("c")
    ).groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("_h"))
    size = F.when(hi > lo, F.lit(bins)).otherwise(1)
    hist = F.transform(F.sequence(F.lit(0), size - 1), lambda b: F.coalesce(F.try_element_at("_h", b), F.lit(0).cast("long")))
    return base.join(exact_quantiles(long, ["metric"], "value", probs), "metric").join(counts, "metric").withColumn(
        "histogram", hist
    ).drop("_h")


def _stats(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, mean and sd per key, rounded to six places before effect sizes."""
    return long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_samp("value"), 6).alias("sd"),
    )


def group_effect_sizes(df: DataFrame, group: str, reference: str, metrics: Sequence[str]) -> DataFrame:
    """Cohen's d of the reference class against each class and against all others (``__others__``)."""
    long = unpivot(df, [group], metrics)
    classes = _stats(long, ["metric", group])
    others = _stats(long.where(F.col(group) != reference), ["metric"]).withColumn(group, F.lit("__others__"))
    ref = classes.where(F.col(group) == reference).select(
        "metric", F.col("n").alias("ref_n"), F.col("mean").alias("ref_mean"), F.col("sd").alias("ref_sd")
    )
    sides = classes.where(F.col(group) != reference).unionByName(others)
    d = cohens_d(*[F.col(c) for c in ("ref_mean", "ref_sd", "ref_n", "mean", "sd", "n")])
    return sides.join(ref, "metric").withColumn("cohens_d", F.round(d, 4)).where(F.col("cohens_d").isNotNull()).withColumn(
        "direction", F.when(F.col("cohens_d") > 0, "reference_higher").otherwise("class_higher")
    )


def within_group_effects(
    df: DataFrame, keys: Sequence[str], suffix: str, metrics: Sequence[str], min_size: int = 3, excluded: str = "N"
) -> tuple[DataFrame, DataFrame]:
    """Effects of suffixed against plain alleles inside each group: (per group and metric, per metric).

    A single suffixed allele is measured by the plain alleles' sd.
    """
    keys = list(keys)
    kind = F.when(F.col(suffix).isNull(), "plain").when(F.col(suffix) != excluded, "suffixed")
    marked = df.withColumn("_kind", kind)
    sized = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("_kind") == "plain").alias("n_plain"),
        F.count_if(F.col("_kind") == "suffixed").alias("n_suffixed"),
    ).where((F.col("n_total") >= min_size) & (F.col("n_plain") > 0) & (F.col("n_suffixed") > 0))
    long = unpivot(marked.where(F.col("_kind").isNotNull()), [*keys, "_kind"], metrics)
    stats = _stats(long, [*keys, "metric", "_kind"])
    pick = lambda c, k: F.max(F.when(F.col("_kind") == k, F.col(c)))
    wide = stats.groupBy(*keys, "metric").agg(
        *[pick(c, k).alias(f"{k}_{c}") for k in ("plain", "suffixed") for c in ("n", "mean", "sd")]
    ).join(sized, keys)
    p = {c: F.col(c) for c in wide.columns}
    pooled = cohens_d(p["plain_mean"], p["plain_sd"], p["plain_n"], p["suffixed_mean"], p["suffixed_sd"], p["suffixed_n"])
    single = F.when(p["plain_sd"] > 0, (p["plain_mean"] - p["suffixed_mean"]) / p["plain_sd"])
    d = F.when(p["suffixed_sd"].isNotNull(), pooled).when(p["suffixed_n"] == 1, single)
    groups = wide.withColumn("cohens_d", F.round(d, 4)).where(F.col("cohens_d").isNotNull())
    positive, total = F.count_if(F.col("cohens_d") > 0), F.count(F.lit(1))
    overall = groups.groupBy("metric").agg(
        total.alias("n_groups"), F.round(F.avg("cohens_d"), 4).alias("mean_d"),
        F.round(F.avg(F.abs("cohens_d")), 4).alias("mean_abs_d"), positive.alias("n_positive"),
        F.round(F.greatest(positive, total - positive) / total, 3).alias("direction_consistency"),
    )
    return groups, overall


def metric_variance_rank(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Variance and range per metric inside each group (two values at least), ranked by variance."""
    stats = unpivot(df, keys, metrics).groupBy(*keys, "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ).where(F.col("n") >= 2)
    order = Window.partitionBy(*keys).orderBy(F.col("variance").desc(), "metric")
    return stats.withColumn("rank", F.row_number().over(order))


def benjamini_hochberg(df: DataFrame, p: str, out: str) -> DataFrame:
    """Adjusted p-values. Ranks come from bucketed counts; the running minimum from the top runs
    over distinct p-values in range chunks, so no task holds all tests."""
    from spanframe.operators.scan import running

    ranks = value_ranks(df, [], p).withColumn(
        "_raw", F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n_at"))
    ).withColumns({"_order": F.col("n_before").cast("long"), "_g": F.lit(0)})
    low = running(ranks, ["_g"], "_order", {"_adj": ("min", "_raw")}, chunk=1 << 16, reverse=True)
    return df.join(low.select(p, F.least(F.lit(1.0), F.col("_adj")).alias(out)), p, "left")


def differential_methylation(
    df: DataFrame, feature: str, group: str, first: str, second: str, beta: str = "beta"
) -> DataFrame:
    """Two-group test per feature on M-values (capped at +-10) with pooled variance, BH-adjusted.

    ``delta_beta`` is the difference of mean betas. Rows outside both groups are ignored.
    """
    b = F.col(beta)
    m = F.when((b > 0) & (b < 1), F.least(F.lit(10.0), F.greatest(F.lit(-10.0), F.log2(b / (1 - b))))).when(
        b <= 0, -10.0).when(b >= 1, 10.0)
    one, two = F.col(group) == first, F.col(group) == second
    rows = df.where((one | two) & b.isNotNull()).withColumn("_m", m)
    stats = rows.groupBy(feature).agg(
        *[f(F.when(g, F.col("_m"))).alias(f"{n}{i}") for i, g in ((1, one), (2, two))
          for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))],
        (F.avg(F.when(one, b)) - F.avg(F.when(two, b))).alias("delta_beta"),
    ).where((F.col("n1") >= 2) & (F.col("n2") >= 2))
    freedom = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / freedom
    tested = stats.withColumn("_s", pooled).where(F.col("_s") > 0).withColumn(
        "t", (F.col("m1") - F.col("m2")) / F.sqrt(F.col("_s") * (1 / F.col("n1") + 1 / F.col("n2")))
    ).withColumn("p_value", p_value_t(F.col("t"), freedom.cast("double")))
    return benjamini_hochberg(tested, "p_value", "adj_p").select(
        feature, "n1", "n2", (F.col("m1") - F.col("m2")).alias("log_fc"), "t", "p_value", "adj_p", "delta_beta"
    )


def cosine_similar(vectors: DataFrame, queries: DataFrame, identity: str, k: int, min_coverage: float = 0.5, slots: int | None = None) -> DataFrame:
    """Top ``k`` similar rows per query vector by masked cosine over all rows, whatever the number of row parts (``slots``)."""
    return most_similar(vectors, queries, identity, k, min_coverage=min_coverage, parts=slots)


def sample_windows(windows: DataFrame, n: int, seed: int, keys: Sequence[str], unknown: str | None = None) -> DataFrame:
    """Seeded random sample of windows with under 5 % unknown bases: the ``n`` smallest md5 of ``keys|seed``."""
    good = windows.where(F.col(unknown) < 0.05) if unknown else windows
    return global_top_k(good, [F.md5(F.concat_ws("|", *keys, F.lit(seed))), *keys], n)


def top_variable(df: DataFrame, feature: str, value: str, n: int) -> DataFrame:
    """Features of highest sample variance; features with a missing value are left out."""
    stats = df.groupBy(feature).agg(
        F.var_samp(value).alias("variance"), F.count_if(F.col(value).isNull()).alias("_missing")
    ).where((F.col("_missing") == 0) & F.col("variance").isNotNull())
    return global_top_k(stats.drop("_missing"), [F.col("variance").desc(), feature], n)


def drift(pinned: DataFrame, computed: DataFrame, abs_tol: float = 1e-9, rel_tol: float = 1e-6) -> DataFrame:
    """Difference of recomputed statistics (stat_id, value) from pinned ones, and whether it is tolerable."""
    joined = pinned.select("stat_id", F.col("value").alias("pinned")).join(
        computed.select("stat_id", F.col("value").alias("computed")), "stat_id", "full"
    )
    gap = F.abs(F.col("pinned") - F.col("computed"))
    scale = F.greatest(F.abs("pinned"), F.abs("computed"), F.lit(1.0))
    both = F.col("pinned").isNotNull() & F.col("computed").isNotNull()
    return joined.withColumns({"abs_diff": F.when(both, gap), "rel_diff": F.when(both, gap / scale)}).withColumn(
        "within_tolerance", F.when(both, (F.col("abs_diff") <= abs_tol) | (F.col("rel_diff") <= rel_tol))
    )

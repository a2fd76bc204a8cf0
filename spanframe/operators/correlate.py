"""Cross-layer statistics over aligned bins.

Two binned layers meet in one full outer join; every statistic then is a set of
distributive sums per group, and only the finished sums (one row per group)
reach the p-value functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.coords import bin_start
from spanframe.functions.stats import safe_corr
from spanframe.functions.pvalues import p_value_fisher, p_value_t
from spanframe.operators.overlap import KEYS
from spanframe.operators.scan import avg_rank

STATISTICS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {}


def register_statistic(name: str, fn: Callable[[DataFrame, Sequence[str]], DataFrame]) -> None:
    """Plug in a statistic: a function from aligned bins (value_a, value_b) and group columns to a DataFrame."""
    STATISTICS[name] = fn


def bin_layer(layer: DataFrame, resolution: int, value: Column, out: str, pos: str = "start_pos") -> DataFrame:
    """One aggregated value per bin of the feature start."""
    return layer.groupBy(*KEYS, bin_start(F.col(pos), resolution).alias("bin_start")).agg(value.alias(out))


def align_bins(a: DataFrame, b: DataFrame, keys: Sequence[str] = (*KEYS, "bin_start")) -> DataFrame:
    """Full outer join of two binned layers; a bin missing on one side counts as 0."""
    return a.join(b, list(keys), "full").fillna(0, ["value_a", "value_b"])


def dense_bins(aligned: DataFrame, resolution: int) -> DataFrame:
    """Add the bins that are empty in both layers, between each chromosome's first and last bin."""
    span = aligned.groupBy(*KEYS).agg(F.min("bin_start").alias("_lo"), F.max("bin_start").alias("_hi"))
    spine = span.select(
        *KEYS, F.explode(F.sequence("_lo", "_hi", F.lit(resolution).cast("long"))).alias("bin_start")
    )
    return spine.join(aligned, [*KEYS, "bin_start"], "left").fillna(0, ["value_a", "value_b"])


def pearson(aligned: DataFrame, by: Sequence[str]) -> DataFrame:
    """r, two-sided p, 95 % interval, means and sample sds per group."""
    a, b = F.col("value_a").cast("double"), F.col("value_b").cast("double")
    stats = aligned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        safe_corr(a, b).alias("_r"),
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.stddev_samp(a).alias("sd_a"), F.stddev_samp(b).alias("sd_b"),
    )
    defined = (F.col("n") >= 3) & (F.col("sd_a") > 0) & (F.col("sd_b") > 0)
    r = F.when(defined, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_r"))))
    stats = stats.withColumn("r", r)
    inner = (F.abs(F.col("r")) < 1.0) & (F.col("n") > 3)
    z = 0.5 * F.log((1 + F.col("r")) / (1 - F.col("r")))
    se = 1.96 / F.sqrt(F.col("n") - 3)
    t = F.when(F.abs(F.col("r")) < 1.0, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    p = F.when(F.abs(F.col("r")) >= 1.0, F.lit(0.0)).otherwise(p_value_t(t, (F.col("n") - 2).cast("double")))
    reason = F.when(F.col("n") < 3, "insufficient_data").when(F.col("r").isNull(), "zero_variance")
    return stats.select(
        *by, "n", "r", p.alias("p_value"),
        F.when(inner, F.tanh(z - se)).alias("ci_low"), F.when(inner, F.tanh(z + se)).alias("ci_high"),
        "mean_a", "mean_b", "sd_a", "sd_b", reason.alias("reason"),
    )


def spearman(aligned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pearson over mid-ranks within each group."""
    ranked = avg_rank(avg_rank(aligned, "value_a", "_ra", by), "value_b", "_rb", by)
    return pearson(ranked.select(*by, F.col("_ra").alias("value_a"), F.col("_rb").alias("value_b")), by)


def _presence(aligned: DataFrame, by: Sequence[str]) -> DataFrame:
    a, b = F.col("value_a") > 0, F.col("value_b") > 0
    return aligned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"),
        F.count_if(a & b).alias("n_both"), F.count_if(a | b).alias("n_either"),
    )


def _fisher_p() -> Column:
    n, n_a, n_b, both = (F.col(c) for c in ("n", "n_a", "n_b", "n_both"))
    return p_value_fisher(both, n_a - both, n_b - both, n - n_a - n_b + both)


def overlap_enrichment(aligned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Observed over expected bins occupied by both layers, with the Fisher p."""
    some = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    expected = F.col("n_a") * F.col("n_b") / F.col("n")
    return _presence(aligned, by).select(
        *by, "n", "n_a", "n_b", "n_both", F.when(some, expected).alias("expected"),
        F.when(some, F.col("n_both") / expected).alias("value"), F.when(some, _fisher_p()).alias("p_value"),
    )


def jaccard(aligned: DataFrame, by: Sequence[str]) -> DataFrame:
    return _presence(aligned, by).select(
        *by, "n", "n_both", "n_either",
        F.when(F.col("n_either") > 0, F.col("n_both") / F.col("n_either")).alias("value"),
    )


def fisher_exact(aligned: DataFrame, by: Sequence[str]) -> DataFrame:
    """2x2 table of occupied bins, odds ratio and two-sided p.

    Bins empty in both layers are absent from the aligned table, so ``neither``
    counts only what the caller supplies; use ``dense_bins`` first for the full grid.
    """
    tab = _presence(aligned, by).withColumns(
        {
            "a_only": F.col("n_a") - F.col("n_both"),
            "b_only": F.col("n_b") - F.col("n_both"),
            "neither": F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_both"),
        }
    )
    odds = (F.col("n_both") * F.col("neither")) / (F.col("a_only") * F.col("b_only"))
    return tab.select(
        *by, "n", F.col("n_both").alias("both"), "a_only", "b_only", "neither",
        F.when((F.col("a_only") > 0) & (F.col("b_only") > 0), odds).alias("value"), _fisher_p().alias("p_value"),
    )


for _name, _fn in (
    ("pearson_r", pearson), ("spearman_rho", spearman), ("overlap_enrichment", overlap_enrichment),
    ("jaccard", jaccard), ("fisher_exact", fisher_exact),
):
    register_statistic(_name, _fn)

COUNT_ONLY = ("overlap_enrichment", "jaccard", "fisher_exact")


def correlate(
    layer_a: DataFrame, layer_b: DataFrame, statistic: str, resolution: int,
    value_a: Column | None = None, value_b: Column | None = None,
    pos_a: str = "start_pos", pos_b: str = "start_pos", by: Sequence[str] = KEYS, dense: bool = False,
    modes: tuple[str, str] = ("count", "count"),
) -> DataFrame:
    """Bin two layers, align the bins and compute one statistic per group (chromosome by default)."""
    if statistic in COUNT_ONLY and set(modes) != {"count"}:
        raise ValueError(f"{statistic} needs two count layers")
    a = bin_layer(layer_a, resolution, value_a if value_a is not None else F.count(F.lit(1)), "value_a", pos_a)
    b = bin_layer(layer_b, resolution, value_b if value_b is not None else F.count(F.lit(1)), "value_b", pos_b)
    aligned = align_bins(a, b)
    if dense:
        aligned = dense_bins(aligned, resolution)
    return STATISTICS[statistic](aligned, list(by))

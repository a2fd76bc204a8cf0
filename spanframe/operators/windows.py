"""Fixed-window derivations: density, coverage, weighted means, track tables.

A feature reaches its windows by exploding the window range inside the scan
stage; every aggregate then combines on the map side before its one shuffle on
``(build, chr_id, window)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.classify import fragility_level
from spanframe.functions.coords import bin_start
from spanframe.operators.nearest import nearest_distance
from spanframe.operators.overlap import KEYS
from spanframe.operators.scan import exact_quantiles

WINDOW_KEY = (*KEYS, "start_pos")


def covered_windows(df: DataFrame, size: int = 1000) -> DataFrame:
    """One row per (feature, window it touches) with the overlap in bp as ``bp``."""
    first = bin_start(F.col("start_pos"), size)
    last = bin_start(F.col("end_pos") - 1, size)
    spread = df.withColumn("_w", F.explode(F.sequence(first, F.greatest(first, last), F.lit(size).cast("long"))))
    bp = F.least(F.col("end_pos"), F.col("_w") + size) - F.greatest(F.col("start_pos"), F.col("_w"))
    return spread.withColumn("bp", bp).drop("start_pos", "end_pos").withColumnRenamed("_w", "start_pos")


def overlap_count_per_window(windows: DataFrame, layer: DataFrame, out: str, size: int = 1000) -> DataFrame:
    """Features overlapping each window; 0 where none."""
    counts = covered_windows(layer.select(*KEYS, "start_pos", "end_pos"), size).groupBy(*WINDOW_KEY).agg(
        F.count(F.lit(1)).alias(out)
    )
    return windows.join(counts, list(WINDOW_KEY), "left").fillna({out: 0})


def max_signal_per_window(layer: DataFrame, mark: str, marks: list[str], score: str, size: int = 1000) -> DataFrame:
    """Largest signal per window, one column per mark."""
    spread = covered_windows(layer.select(*KEYS, "start_pos", "end_pos", mark, score), size)
    return spread.groupBy(*WINDOW_KEY).pivot(mark, marks).agg(F.max(score))


def coverage_fraction(
    windows: DataFrame, layer: DataFrame, classes: dict[str, Column], size: int = 1000, cap: bool = True,
    total: str | None = None,
) -> DataFrame:
    """Share of each window covered by features of each class.

    Overlapping features count twice before the cap. ``total`` adds the capped
    sum of all classes. Windows without features get 0.
    """
    spread = covered_windows(layer, size)
    sums = spread.groupBy(*WINDOW_KEY).agg(
        *[F.sum(F.when(test, F.col("bp")).otherwise(0)).alias(name) for name, test in classes.items()]
    )
    out = windows.join(sums, list(WINDOW_KEY), "left")
    for name in classes:
        fraction = F.coalesce(F.col(name), F.lit(0)) / F.lit(float(size))
        out = out.withColumn(name, F.least(F.lit(1.0), fraction) if cap else fraction)
    if total:
        out = out.withColumn(total, F.least(F.lit(1.0), sum((F.col(c) for c in classes), F.lit(0.0))))
    return out


def median_per_window(layer: DataFrame, value: str, out: str = "median", size: int = 1000) -> DataFrame:
    """Exact median of a value over the features overlapping each window."""
    spread = covered_windows(layer.select(*KEYS, "start_pos", "end_pos", value), size)
    return exact_quantiles(spread, WINDOW_KEY, value, {out: 0.5}, buckets=16)


def window_weighted_mean(layer: DataFrame, value: str, out: str = "mean", size: int = 1000) -> DataFrame:
    """Sum of value times overlap over the window size; windows without cover do not appear."""
    spread = covered_windows(layer.select(*KEYS, "start_pos", "end_pos", value), size)
    return spread.groupBy(*WINDOW_KEY).agg((F.sum(F.col(value) * F.col("bp")) / F.lit(float(size))).alias(out))


def broadcast_to_windows(
    centers: DataFrame, values: Sequence[str], reach: int = 1_000_000, size: int = 1000
) -> DataFrame:
    """Spread coarse rates (``pos`` is the centre) over the fine windows around them; the later centre wins."""
    low = F.greatest(F.lit(0).cast("long"), (F.col("pos") - reach // 2).cast("long"))
    high = (F.col("pos") + reach // 2).cast("long")
    spread = centers.where(high > low).select(
        *KEYS, "pos", *values, F.explode(F.sequence(low, high - 1, F.lit(size).cast("long"))).alias("start_pos")
    )
    return spread.groupBy(*WINDOW_KEY).agg(*[F.max_by(F.col(v), F.col("pos")).alias(v) for v in values])


def bin_mutations(df: DataFrame, groups: DataFrame, group_names: list[str], size: int = 1000) -> DataFrame:
    """Mutation counts per window: all, single-base, indel, and one column per cancer group.

    ``groups`` maps ``project`` to ``cancer_group``; it is a small fixed table.
    """
    single = (F.length("ref") == 1) & (F.length("alt") == 1)
    marked = df.join(groups, "project", "left")
    return (
        marked.groupBy(*KEYS, bin_start(F.col("pos"), size).alias("start_pos"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(single).alias("snv"),
            F.count_if(~single).alias("indel"),
            *[F.count_if(F.col("cancer_group") == g).alias(g) for g in group_names],
        )
    )


def bin_methylation(df: DataFrame, cell_types: list[str], size: int = 1000) -> DataFrame:
    """Mean beta per window and cell type, wide, with the spread across cell types."""
    per_type = df.groupBy(*KEYS, bin_start(F.col("pos"), size).alias("start_pos"), "cell_type").agg(
        F.avg("beta").alias("beta"), F.count(F.lit(1)).alias("n")
    )
    return per_type.groupBy(*WINDOW_KEY).agg(
        F.max("n").alias("n_cpgs"),
        *[F.max(F.when(F.col("cell_type") == c, F.col("beta"))).alias(c) for c in cell_types],
        F.avg("beta").alias("mean_beta"),
        F.coalesce(F.var_samp("beta"), F.lit(0.0)).alias("beta_variance"),
        (F.max("beta") - F.min("beta")).alias("beta_range"),
    )


def summary_bins(df: DataFrame, size: int = 10_000) -> DataFrame:
    """Mean beta and number of probes per coarse bin and cell type."""
    return df.groupBy(*KEYS, "cell_type", bin_start(F.col("pos"), size).alias("start_pos")).agg(
        F.avg("beta").alias("mean_beta"), F.count(F.lit(1)).alias("n_probes")
    )


def bin_signal(signal: DataFrame, tracks: list[str], size: int = 1000) -> DataFrame:
    """Overlap-weighted mean, minimum and maximum of each signal track per window.

    Tracks without data in a window stay null.
    """
    spread = covered_windows(signal.select(*KEYS, "start_pos", "end_pos", "track", "score"), size)
    cols = []
    for t in tracks:
        here = F.col("track") == t
        weight = F.sum(F.when(here, F.col("bp")))
        cols.append((F.sum(F.when(here, F.col("score") * F.col("bp"))) / weight).alias(f"{t}_mean"))
        cols.append(F.min(F.when(here, F.col("score"))).alias(f"{t}_min"))
        cols.append(F.max(F.when(here, F.col("score"))).alias(f"{t}_max"))
    return spread.groupBy(*WINDOW_KEY).agg(*cols)


def add_tracks(windows: DataFrame, staging: DataFrame, tracks: list[str]) -> DataFrame:
    """Overwrite or add track columns where staging has the window; other rows keep their value.

    ``staging`` is long: window key, ``track``, ``value``. All tracks go in with
    one pivot and one join, not one update per track.
    """
    wide = staging.groupBy(*WINDOW_KEY).agg(
        F.lit(True).alias("_hit"), *[F.max(F.when(F.col("track") == t, F.col("value"))).alias(f"_{t}") for t in tracks]
    )
    out = windows.join(wide, list(WINDOW_KEY), "left")
    for t in tracks:
        old = F.col(t) if t in windows.columns else F.lit(None).cast("double")
        out = out.withColumn(t, F.when(F.col("_hit"), F.col(f"_{t}")).otherwise(old))
    return out.drop("_hit", *[f"_{t}" for t in tracks])


def window_star_join(base: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """Left-join any number of window tables on the window key.

    All sides hash on the same key, so the base is shuffled once and every later
    join reuses that partitioning.
    """
    out = base
    for layer in layers:
        out = out.join(layer, list(WINDOW_KEY), "left")
    return out


def minmax_by(df: DataFrame, value: str, out: str, keys: Sequence[str] = ("chr_id",)) -> DataFrame:
    """Scale to 0..1 per group; a constant group gives 0. The group range is one aggregated row."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(span, keys, "left").withColumn(
        out, F.when(F.col(value).isNotNull(), F.coalesce(scaled, F.lit(0.0)))
    ).drop("_lo", "_hi")


def fragility_composite(windows: DataFrame, nonb: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """Composite fragility of windows that have both physics and non-B density.

    ``windows`` brings ``curvature`` and ``stacking``; ``nonb`` brings
    ``nonb_density``. Components are scaled per chromosome, stacking is
    inverted, and breakpoints count by exponential decay of their distance.
    """
    both = windows.join(nonb, list(WINDOW_KEY)).fillna(0.0, ["curvature", "stacking", "nonb_density"])
    located = nearest_distance(both.withColumn("pos", F.floor((F.col("start_pos") + F.col("end_pos")) / 2)), breakpoints)
    span = located.groupBy(*KEYS).agg(
        *[f(c).alias(f"_{n}_{c}") for c in ("nonb_density", "curvature", "stacking")
          for n, f in (("lo", F.min), ("hi", F.max))]
    )
    joined = located.join(span, list(KEYS), "left")

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)

    decay = F.exp(F.lit(-0.6931471805599453 / K.BREAKPOINT_HALF_LIFE) * F.col("distance"))
    w = K.FRAGILITY_WEIGHTS
    parts = joined.withColumns(
        {
            "nonb_component": scaled("nonb_density"),
            "curvature_component": scaled("curvature"),
            "stacking_component": 1.0 - scaled("stacking"),
            "bp_component": F.coalesce(decay, F.lit(0.0)),
        }
    ).withColumn(
        "fragility_score",
        w["nonb"] * F.col("nonb_component") + w["curvature"] * F.col("curvature_component")
        + w["stacking"] * F.col("stacking_component") + w["bp_prox"] * F.col("bp_component"),
    )
    return parts.withColumn("fragility_level", fragility_level(F.col("fragility_score"))).select(
        *KEYS, "start_pos", "end_pos", "nonb_component", "curvature_component", "stacking_component", "bp_component",
        "fragility_score", "fragility_level",
    )


def rolling_mean(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, width: int, chunk: int = 4096
) -> DataFrame:
    """Centred mean over ``order`` +- width//2 (an integer position), truncated at the edges, nulls skipped.

    Rows near a chunk's border are copied to the neighbour as a halo, so a long
    series never becomes one task.
    """
    half = width // 2
    at = F.col(order)
    home = F.floor(at / chunk)
    chunks = F.array_distinct(F.array(home, F.floor((at - half) / chunk), F.floor((at + half) / chunk)))
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(chunks))
    w = Window.partitionBy(*keys, "_chunk").orderBy(order).rangeBetween(-half, half)
    return (
        spread.withColumn(out, F.avg(value).over(w))
        .where(F.col("_home") == F.col("_chunk"))
        .drop("_home", "_chunk")
    )


def tile_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int) -> DataFrame:
    """Mean of consecutive non-overlapping runs of ``width`` positions; the last may be short."""
    return df.groupBy(*keys, F.floor(F.col(order) / width).alias("tile")).agg(F.avg(value).alias("mean"))

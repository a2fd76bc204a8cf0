"""Region queries, profiles, per-region statistics, layer intersection and proximity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.coords import bin_start, field_predicate
from spanframe.operators.overlap import KEYS, count_overlaps, overlap_join
from spanframe.operators.scan import exact_quantiles
from spanframe.operators.topk import top_k_per_group


def region_query(
    layer: DataFrame, regions: DataFrame, limit: int | None = None, tie: Sequence[str] = ("end_pos",),
    levels: list[int] | None = None,
) -> DataFrame:
    """Features overlapping each region: all of them, or a page of the first ``limit`` per region in start order.

    A page has ``rank``, ``n_returned`` and ``status``, ``truncated`` where the limit was reached; the limit is
    applied as a group limit before the shuffle. Without one nothing is ranked.
    """
    pairs = overlap_join(
        regions.select("region_id", *KEYS, "start_pos", "end_pos"), layer, levels=levels, prefix="f_"
    )
    if limit is None:
        return pairs
    order = [F.col("f_start_pos"), *[F.col("f_" + t) for t in tie]]
    capped = top_k_per_group(pairs, ["region_id"], order, limit, rank="rank")
    sizes = capped.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_returned"))
    return capped.join(sizes, "region_id").withColumn(
        "status", F.when(F.col("n_returned") >= limit, "truncated").otherwise("complete")
    )


def window_start_query(layer: DataFrame, regions: DataFrame, value: str, size: int) -> DataFrame:
    """Windows whose start falls inside a region (no overlap test) and whose value is known."""
    tiles = F.sequence(bin_start(F.col("start_pos") + size - 1, size), F.col("end_pos") - 1, F.lit(size).cast("long"))
    starts = regions.where(F.col("end_pos") - 1 >= bin_start(F.col("start_pos") + size - 1, size)).select(
        "region_id", *KEYS, F.explode(tiles).alias("start_pos")
    )
    return starts.join(layer.where(F.col(value).isNotNull()), [*KEYS, "start_pos"])


def select_fields(df: DataFrame, fields: Sequence[str], always: Sequence[str] = (*KEYS, "start_pos", "end_pos")):
    """Keep the coordinates and the requested value columns that exist."""
    return df.select(*always, *[f for f in fields if f in df.columns and f not in always])


def to_columnar(df: DataFrame, by: str, start: str, end: str, values: Sequence[str], tie: Sequence[str] = ()):
    """Rows to parallel arrays per group, 1-based starts, in start order.

    One array per group is the result format itself; callers page groups with
    ``region_query`` first.
    """
    packed = df.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), *tie, *values))).alias("_r")
    )
    return packed.select(
        by,
        F.transform("_r", lambda r: r["s"] + 1).alias("starts"),
        F.transform("_r", lambda r: r["e"]).alias("ends"),
        *[F.transform("_r", _field(v)).alias(v) for v in values],
    )


def _field(name: str):
    return lambda row: row[name]


def region_stats(
    layer: DataFrame, regions: DataFrame, fields: Sequence[str], levels: list[int] | None = None
) -> DataFrame:
    """Long table (region, field): n, mean, sd, min, max and exact quartiles."""
    pairs = overlap_join(regions.select("region_id", *KEYS, "start_pos", "end_pos"), layer, levels=levels)
    values = pairs.select(
        "region_id",
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col("b_" + f).cast("double").alias("value"))
                           for f in fields])),
    )
    keys = ["region_id", "field"]
    return exact_quantiles(values, keys, "value", {"p25": 0.25, "median": 0.5, "p75": 0.75}, buckets=8, moments=True)


def region_counts(layer: DataFrame, regions: DataFrame) -> DataFrame:
    """Count mode: overlapping features and density per kb for every region."""
    counted = count_overlaps(regions, layer, out="n")
    return counted.withColumn("density_per_kb", F.col("n") / ((F.col("end_pos") - F.col("start_pos")) / 1000.0))


def region_profile(regions: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Overlap count of every layer in every region, present or not.

    All layers are stacked and counted in one pass with the layer name as an
    extra key.
    """
    stacked = None
    for name, layer in layers.items():
        part = layer.select(F.lit(name).alias("layer"), *KEYS, "start_pos", "end_pos")
        stacked = part if stacked is None else stacked.unionByName(part)
    asked = regions.select(
        "region_id", *KEYS, "start_pos", "end_pos", F.explode(F.array(*[F.lit(n) for n in layers])).alias("layer")
    )
    counted = count_overlaps(asked, stacked, keys=("layer", *KEYS), out="feature_count")
    length = F.col("end_pos") - F.col("start_pos")
    return counted.select(
        "region_id", "layer", "feature_count", length.alias("region_length"),
        (F.col("feature_count") / (length / 1000.0)).alias("density_per_kb"),
        (F.col("feature_count") > 0).alias("present"),
    )


def significance_flags(profile: DataFrame, layer_types: dict[str, str]) -> DataFrame:
    """Flag rows from a region profile by fixed density rules; ``layer_types`` maps layer to type."""
    kind = F.lit(None).cast("string")
    for layer, layer_type in layer_types.items():
        kind = F.when(F.col("layer") == layer, F.lit(layer_type)).otherwise(kind)
    density, count, length = F.col("density_per_kb"), F.col("feature_count"), F.col("region_length")
    # Thresholds of the rules.
    code = (
        F.when((kind == "cpg") & (density > 80), "HIGH_CPG_DENSITY")
        .when((kind == "cpg") & (density > 0) & (density < 5) & (length >= 1000), "LOW_CPG_DENSITY")
        .when((kind == "conservation") & (count == 0) & (length >= 1000), "NO_CONSERVATION_DATA")
        .when((kind == "regulatory") & (density > 5), "REGULATORY_DENSE")
        .when((kind == "nonb_dna") & (count > 0), "NONB_DNA_PRESENT")
        .when((kind == "gwas") & (count > 0), "GWAS_HITS")
    )
    severity = F.when(F.col("code") == "NONB_DNA_PRESENT", "warning").otherwise("info")
    return profile.withColumn("code", code).where(F.col("code").isNotNull()).withColumn("type", severity)


def gene_neighbourhood(genes: DataFrame, layer: DataFrame, radius: int, levels: list[int] | None = None) -> DataFrame:
    """Features within ``radius`` of each gene's outer bounds per chromosome."""
    bounds = genes.groupBy("symbol", *KEYS).agg(
        F.greatest(F.min("start_pos") - radius, F.lit(0).cast("long")).alias("start_pos"),
        (F.max("end_pos") + radius).alias("end_pos"),
    )
    return overlap_join(bounds, layer, levels=levels)


def hotspot_summary(
    regions: DataFrame, events: DataFrame, hotspots: DataFrame, rates: DataFrame, rate: str, size: int
) -> DataFrame:
    """Labelled counts of events and hotspots plus rate windows for every region, in one table."""
    counts = region_profile(regions, {"events": events, "hotspots": hotspots})
    inside = window_start_query(rates, regions, rate, size)
    rate_rows = inside.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.avg(rate).alias("mean"))
    labelled = counts.select("region_id", F.col("layer").alias("label"), F.col("feature_count").alias("n"),
                             F.lit(None).cast("double").alias("mean"))
    return labelled.unionByName(
        rate_rows.select("region_id", F.lit("rates").alias("label"), "n", "mean")
    )


def filtered(layer: DataFrame, spec: dict, allowed: Sequence[str] | None = None) -> DataFrame:
    """Layer rows passing one filter ``{field, op, value}``."""
    fields = tuple(allowed) if allowed is not None else tuple(layer.columns)
    return layer.where(field_predicate(spec.get("field", ""), spec["op"], spec.get("value"), fields))


#: Layers that share one number of presence bits.
WORD = 60


def intersect_layers(layers: list[DataFrame], mode: str = "exact", levels: list[int] | None = None) -> DataFrame:
    """Intervals present in every (already filtered) layer.

    ``exact`` keeps intervals whose start and end agree in all layers: one
    aggregation over the stacked layers. ``overlap`` keeps intervals of the
    first layer that touch at least one interval of each other layer.
    """
    if not layers:
        raise ValueError("at least one layer")
    place = [*KEYS, "start_pos", "end_pos"]
    if mode == "overlap":
        out = layers[0].select(*place).distinct()
        for layer in layers[1:]:
            out = count_overlaps(out, layer, out="_n").where(F.col("_n") > 0).drop("_n").select(*place)
        return out
    stacked = None
    for i, layer in enumerate(layers):
        part = layer.select(*place, F.lit(i // WORD).alias("_word"), F.lit(1 << i % WORD).cast("long").alias("_bit"))
        stacked = part if stacked is None else stacked.unionByName(part)
    words = range(-(-len(layers) // WORD))
    seen = stacked.groupBy(*place).agg(*[F.bit_or(F.when(F.col("_word") == w, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}") for w in words])
    for w in words:
        seen = seen.where(F.col(f"_w{w}") == (1 << min(WORD, len(layers) - w * WORD)) - 1)
    return seen.select(*place)


def annotate_positions(
    positions: DataFrame, layer: DataFrame, regions: DataFrame | None = None, levels: list[int] | None = None
) -> DataFrame:
    """Layer rows of the searched regions, or (without regions) only those at a matched position."""
    anchor = positions if regions is None else regions
    return overlap_join(anchor, layer, levels=levels)


# Named filter lists.
RECIPES = {
    "silencing_prone_regions": [
        {"layer": "cpg_islands", "op": "overlaps"},
        {"layer": "conservation", "field": "phylop_mean", "op": ">", "value": 2.0},
    ],
    "biophysically_unusual_cpg_islands": [
        {"layer": "cpg_islands", "op": "overlaps"},
        {"layer": "biophysics", "field": "stacking_dg37", "op": "<", "value": -1.7},
    ],
    "regulatory_hotspots": [{"layer": "ccre", "op": "overlaps"}, {"layer": "breakpoints", "op": "overlaps"}],
    "conserved_nonb_dna": [
        {"layer": "nonb_dna", "op": "overlaps"},
        {"layer": "conservation", "field": "phylop_mean", "op": ">", "value": 3.0},
    ],
    "repeat_fragility_zones": [{"layer": "repeats", "op": "overlaps"}, {"layer": "breakpoints", "op": "overlaps"}],
    "tad_boundary_enrichment": [
        {"layer": "tad_domain", "op": "overlaps"},
        {"layer": "ccre", "op": "overlaps"},
        {"layer": "conservation", "field": "phylop_mean", "op": ">", "value": 1.5},
    ],
}


def run_recipe(name: str, layers: dict[str, DataFrame], mode: str = "exact") -> DataFrame:
    """Intersect the filtered layers of a named recipe."""
    return intersect_layers([filtered(layers[f["layer"]], f) for f in RECIPES[name]], mode)


def binned_density(layer: DataFrame, resolution: int, extras: dict[str, Column] | None = None, pos: str = "start_pos"):
    """Features per bin of their start, with density per bp and any extra aggregates."""
    return layer.groupBy(*KEYS, bin_start(F.col(pos), resolution).alias("bin_start")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) / F.lit(float(resolution))).alias("density"),
        *[expr.alias(name) for name, expr in (extras or {}).items()],
    )

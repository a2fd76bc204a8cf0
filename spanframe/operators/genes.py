"""Gene tables: symbol resolution, coordinates, reports, expression summaries and profile vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.classify import degradation_rate, persistence_length
from spanframe.functions.constants import DEFAULT_HALF_LIFE
from spanframe.functions.coords import bin_start
from spanframe.operators.nearest import nearest_within
from spanframe.operators.overlap import KEYS, overlap_join
from spanframe.operators.scan import exact_quantiles, value_ranks
from spanframe.operators.topk import global_top_k


# Persistence length (nm) of methylated DNA, stacking shift of a methylated step (kcal/mol).
METHYLATED_LP = 50.0
METHYLATED_STACKING = 0.5


def unversioned(gene_id: Column) -> Column:
    return F.substring_index(gene_id, ".", 1)


def resolve_symbols(df: DataFrame, genes: DataFrame, aliases: DataFrame, symbol: str = "query") -> DataFrame:
    """Canonical symbol per asked name: upper-case match, else the alias's smallest canonical symbol."""
    known = genes.select(F.upper("symbol").alias("_up"), "symbol").groupBy("_up").agg(F.min("symbol").alias("_direct"))
    other = aliases.groupBy(F.upper("alias").alias("_up")).agg(F.min("canonical").alias("_alias"))
    asked = df.withColumn("_up", F.upper(symbol))
    out = asked.join(known, "_up", "left").join(other, "_up", "left")
    how = F.when(F.col("_direct").isNotNull(), "symbol").when(F.col("_alias").isNotNull(), "alias")
    return out.withColumns({"resolved": F.coalesce("_direct", "_alias"), "matched_by": how}).drop("_up", "_direct", "_alias")


def gene_lookup(df: DataFrame, genes: DataFrame, aliases: DataFrame, symbol: str = "query") -> DataFrame:
    found = resolve_symbols(df, genes, aliases, symbol)
    return found.join(genes, found["resolved"] == genes["symbol"], "left").drop("resolved")


def prefix_search(genes: DataFrame, aliases: DataFrame, text: str, k: int) -> DataFrame:
    """Symbols (exact first) and aliases starting with ``text``; the top-k report of a search box."""
    up = text.upper()
    direct = genes.where(F.upper("symbol").startswith(up)).select(
        "symbol", F.lit("symbol").alias("matched_by"), F.when(F.upper("symbol") == up, 0).otherwise(1).alias("_o")
    )
    via = aliases.where(F.upper("alias").startswith(up)).select(
        F.col("canonical").alias("symbol"), F.lit("alias").alias("matched_by"), F.lit(2).alias("_o")
    )
    best = direct.unionByName(via).groupBy("symbol").agg(F.min(F.struct("_o", "matched_by")).alias("_m")).select(
        "symbol", F.col("_m.matched_by").alias("matched_by"), F.col("_m._o").alias("_o")
    )
    return global_top_k(best, ["_o", "symbol"], k).drop("_o")


def attach_gene_coordinates(df: DataFrame, genes: DataFrame, key: str = "gene_id") -> DataFrame:
    """Give gene-keyed rows their interval; version suffixes of ids are ignored."""
    place = genes.groupBy(unversioned(F.col(key)).alias("_k")).agg(
        F.min(F.struct("chr_id", "start_pos", "end_pos", "build", "symbol")).alias("_g")
    )
    return df.withColumn("_k", unversioned(F.col(key))).join(place, "_k").select(
        *df.columns, "_g.build", "_g.chr_id", "_g.start_pos", "_g.end_pos", "_g.symbol"
    )


def gene_report(symbols: DataFrame, table: DataFrame, key: str = "symbol", order: list | None = None) -> DataFrame:
    """Rows of a gene-keyed table for the asked symbols, in the report's order."""
    out = table.join(symbols.select(key).distinct(), key)
    return out.orderBy(key, *(order or []))


def tissue_specificity(tpm: DataFrame) -> DataFrame:
    """Per gene (long tpm): tau, log medians, log mean of the top three tissues, tissues above 1.0."""
    per = tpm.where(F.col("tpm").isNotNull())
    # A gene has one value per tissue, a small fixed set, so three maxima come from a short array.
    stats = per.groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("tpm").alias("mx"), F.sum("tpm").alias("s"),
        F.slice(F.sort_array(F.collect_list("tpm"), asc=False), 1, 3).alias("top"), F.count_if(F.col("tpm") > 1.0).alias("d"),
    ).where(F.col("n") >= 2)
    med = exact_quantiles(per, ["gene_id"], "tpm", {"median": 0.5}, buckets=16)
    top = F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.size("top")
    return stats.join(med, "gene_id").select(
        "gene_id", F.when(F.col("mx") > 0, (F.col("n") - F.col("s") / F.col("mx")) / (F.col("n") - 1)).alias("tau"),
        F.log2(F.col("median") + 1).alias("log_median_tpm"), F.log2(top + 1).alias("log_robust_max_tpm"),
        F.col("d").alias("n_tissues_detected"),
    )


def metabolic_burden(costs: DataFrame, turnover: DataFrame, tpm: DataFrame) -> DataFrame:
    """Cost x length x tpm x degradation rate per gene and tissue, plus the gene's mean expression.

    Genes without a half life use the default.
    """
    lives = turnover.where(F.col("half_life") > 0).select(F.upper("symbol").alias("_u"), "half_life").groupBy("_u").agg(
        F.max("half_life").alias("half_life")
    )
    base = costs.where(F.col("ecpa").isNotNull() & F.col("length").isNotNull()).withColumn("_u", F.upper("symbol"))
    rate = degradation_rate(F.coalesce("half_life", F.lit(DEFAULT_HALF_LIFE)))
    known = base.join(lives, "_u", "left").withColumn("_w", F.col("ecpa") * F.col("length") * rate).drop("_u")
    return known.join(tpm, "gene_id").select("gene_id", "tissue", (F.col("_w") * F.col("tpm")).alias("burden"))


def intrinsic_profile(genes: DataFrame, windows: DataFrame, value: str, levels=None) -> DataFrame:
    """Mean of a window column over the windows each gene touches; null without windows."""
    pairs = overlap_join(genes.select("gene_id", *KEYS, "start_pos", "end_pos"), windows, levels=levels)
    means = pairs.groupBy("gene_id").agg(F.avg("b_" + value).alias("mean_" + value))
    return genes.select("gene_id").join(means, "gene_id", "left")


def _by_symbol(table: DataFrame, *columns) -> DataFrame:
    """One row per upper-case symbol (the largest values, where a symbol repeats); rows without a symbol are left out."""
    return table.where("symbol IS NOT NULL").groupBy(F.upper("symbol").alias("_u")).agg(*columns)


def intrinsic_layer(genes: DataFrame, windows: DataFrame, constraint: DataFrame, gc: str = "gc", levels=None) -> DataFrame:
    """Intrinsic layer of the profile: constraint by symbol, mean GC of the windows a gene touches, log2 length in kb; null where unknown."""
    body = intrinsic_profile(genes, windows, gc, levels).withColumnRenamed("mean_" + gc, "gc_body")
    known = _by_symbol(constraint, F.max("loeuf").alias("loeuf"), F.max("mis_z").alias("mis_z"))
    length = F.col("end_pos") - F.col("start_pos")
    named = genes.select("gene_id", F.upper("symbol").alias("_u"), F.when(length > 0, F.log2(length / 1000.0)).alias("gene_length_log_kb"))
    # Genes without a symbol match nothing; a key of their own keeps them apart in the join.
    keyed = named.withColumn("_u", F.coalesce("_u", F.concat(F.lit("\u0000"), F.col("gene_id").cast("string"))))
    return keyed.join(known, "_u", "left").drop("_u").join(body, "gene_id", "left").select("gene_id", "loeuf", "mis_z", "gc_body", "gene_length_log_kb")


def protein_profile(genes: DataFrame, abundance: DataFrame, costs: DataFrame) -> DataFrame:
    """Protein layer of the profile, by symbol: log2 of the largest abundance (ppm) plus one, share of expensive residues, energy cost per residue; null where unknown."""
    most = _by_symbol(abundance, F.log2(F.coalesce(F.max("abundance_ppm"), F.lit(0.0)) + 1).alias("log_max_ppm"))
    share = F.coalesce("frac_expensive", F.lit(0.0)) + F.coalesce("frac_very_expensive", F.lit(0.0))
    cost = _by_symbol(costs, F.max(share).alias("frac_expensive_aa"), F.max("ecpa_b20").alias("ecpa_b20"))
    named = genes.select("gene_id", F.coalesce(F.upper("symbol"), F.concat(F.lit("\u0000"), F.col("gene_id").cast("string"))).alias("_u"))
    return named.join(most, "_u", "left").join(cost, "_u", "left").select("gene_id", "log_max_ppm", "frac_expensive_aa", "ecpa_b20")


def profile_long(values: DataFrame) -> DataFrame:
    """z-score (sample sd, sd 0 as 1) and percentile per dimension of long (gene_id, dimension, value).

    Dimensions with fewer than two known values give nulls.
    """
    stats = values.groupBy("dimension").agg(
        F.count("value").alias("_n"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s")
    )
    ranks = value_ranks(values, ["dimension"], "value").select(
        "dimension", "value", ((F.col("n_before") + F.col("n_at")) / F.col("n_total") * 100.0).alias("_p")
    )
    spread = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    usable = (F.col("_n") >= 2) & F.col("value").isNotNull()
    # Nulls have no rank and stay out of the join, where they would meet in one task.
    known = values.where(F.col("value").isNotNull()).join(ranks, ["dimension", "value"])
    every = known.unionByName(values.where(F.col("value").isNull()).withColumn("_p", F.lit(None).cast("double")), allowMissingColumns=True)
    return every.join(stats, "dimension").select(
        "gene_id", "dimension", "value", F.when(usable, (F.col("value") - F.col("_m")) / spread).alias("z"),
        F.when(usable, F.col("_p")).alias("percentile"),
    )


def profile_vectors(values: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """One vector per gene in the order of ``dimensions``: z, mask of missing places, norm and number present."""
    long = profile_long(values)
    cells = [F.max(F.when(F.col("dimension") == d, F.col("z"))).alias(f"_z{i}") for i, d in enumerate(dimensions)]
    wide = long.groupBy("gene_id").agg(*cells)
    z = [F.col(f"_z{i}") for i in range(len(dimensions))]
    total = sum((F.coalesce(c * c, F.lit(0.0)) for c in z), F.lit(0.0))
    return wide.select(
        "gene_id", F.array(*[F.coalesce(c, F.lit(0.0)) for c in z]).alias("vector"),
        F.array(*[c.isNull() for c in z]).alias("mask"), F.sqrt(total).alias("norm"),
        sum((F.when(c.isNotNull(), 1).otherwise(0) for c in z), F.lit(0)).alias("n_present"),
    )


def tail_anomalies(long: DataFrame, cut: float = 2.0) -> DataFrame:
    return long.where(F.abs("z") > cut).withColumn("direction", F.when(F.col("z") > 0, "high").otherwise("low"))


def gene_profile_report(genes: DataFrame, vectors: DataFrame, long: DataFrame) -> DataFrame:
    """Identity, vector and packed anomalies per gene (anomalies are at most one per dimension)."""
    odd = tail_anomalies(long).groupBy("gene_id").agg(
        F.array_sort(F.collect_list(F.struct("dimension", "z", "direction"))).alias("anomalies")
    )
    return genes.select("gene_id", "symbol").join(vectors, "gene_id", "left").join(odd, "gene_id", "left")


def _once_per_symbol(table: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per upper-case symbol (the least of several), with the fields."""
    one = table.where("symbol IS NOT NULL").groupBy(F.upper("symbol").alias("_gene")).agg(F.min(F.struct(*fields)).alias("_f"))
    return one.select("_gene", *[F.col("_f")[c].alias(c) for c in fields])


def _window_of(sites: DataFrame, windows: DataFrame, size: int = 1000) -> DataFrame:
    """Sites with the columns of the window they lie in, null without one."""
    return sites.withColumn("start_pos", bin_start(F.col("pos"), size)).join(windows.drop("end_pos"), [*KEYS, "start_pos"], "left").drop("start_pos")


def site_layers(
    profile: DataFrame, identity: str, islands: DataFrame | None = None, chromatin: DataFrame | None = None, conservation: DataFrame | None = None,
    constraint: DataFrame | None = None, expression: DataFrame | None = None, levels: list[int] | None = None,
) -> DataFrame:
    """Further layers beside a ``site_profile``; each is left out where it is not given.

    ``islands``: context of the site. ``chromatin`` (state, epigenome): the distinct states over it, in order. ``conservation``: 1 kb windows.
    ``constraint`` and ``expression`` (symbol, ...): values of the gene over the site, else of the nearest one, and ``gene_evidence`` tells which.
    With a context and ``gc`` comes the stiffness model: persistence length without and with methylation, change in percent, stacking shift.
    """
    from spanframe.operators.nearest import classify_sites
    from spanframe.operators.overlap import as_interval

    places = profile.select(identity, *KEYS, "pos")
    out = profile
    if islands is not None:
        out = out.join(classify_sites(places, islands, [identity]).select(identity, "context"), identity, "left")
    if chromatin is not None:
        over = overlap_join(as_interval(places), chromatin.select(*KEYS, "start_pos", "end_pos", "state", "epigenome"), levels=levels, length=1)
        states = over.groupBy(identity).agg(F.array_sort(F.collect_set(F.struct(F.col("b_state").alias("state"), F.col("b_epigenome").alias("epigenome")))).alias("chromatin"))
        out = out.join(states, identity, "left")
    if conservation is not None:
        out = _window_of(out, conservation)
    tables = [t for t in (constraint, expression) if t is not None]
    if tables:
        out = out.withColumns({
            "_gene": F.upper(F.coalesce("first_gene", "nearest_gene")),
            "gene_evidence": F.when(F.col("first_gene").isNotNull(), "overlap").when(F.col("nearest_gene").isNotNull(), "nearest"),
        })
        for table in tables:
            out = out.join(_once_per_symbol(table, [c for c in table.columns if c != "symbol"]), "_gene", "left")
        out = out.drop("_gene")
    if islands is not None and "gc" in out.columns:
        bare = F.when(F.col("context").isNotNull(), F.round(persistence_length(F.col("gc")), 1))
        out = out.withColumns({"lp_bare": bare, "lp_methylated": F.when(bare.isNotNull(), METHYLATED_LP)}).withColumns({
            "delta_lp_pct": F.when(bare > 0, F.round((METHYLATED_LP - bare) / bare * 100, 1)), "ddg_stacking": F.when(bare.isNotNull(), METHYLATED_STACKING)})
    return out


def site_profile(
    sites: DataFrame, identity: str, genes: DataFrame, elements: DataFrame, windows: DataFrame, levels: list[int] | None = None
) -> DataFrame:
    """One row per site: nearest gene within 100 kb, genes and elements over it, window physics, persistence length."""
    from spanframe.operators.overlap import as_interval

    near = nearest_within(sites.select(identity, *KEYS, "pos"), genes.select(*KEYS, "start_pos", "end_pos", "symbol"),
                          [identity], 100_000, symbol="symbol").select(identity, F.col("b_symbol").alias("nearest_gene"), "distance")
    points = as_interval(sites.select(identity, *KEYS, "pos"))
    inside = overlap_join(points, genes.select(*KEYS, "start_pos", "end_pos", "symbol"), length=1).groupBy(identity).agg(
        F.count(F.lit(1)).alias("n_genes"), F.min("b_symbol").alias("first_gene"))
    over = overlap_join(points, elements.select(*KEYS, "start_pos", "end_pos"), levels=levels).groupBy(identity).agg(
        F.count(F.lit(1)).alias("n_elements"))
    placed = _window_of(sites.select(identity, *KEYS, "pos"), windows)
    out = placed.join(near, identity, "left").join(inside, identity, "left").join(over, identity, "left")
    out = out.fillna(0, ["n_genes", "n_elements"])
    return out.withColumn("lp_nm", persistence_length(F.col("gc"))) if "gc" in out.columns else out


def variant_cross_reference(
    variants: DataFrame, windows: DataFrame, known: DataFrame, elements: DataFrame, levels: list[int] | None = None, k: int | None = None,
    conservation: DataFrame | None = None,
) -> DataFrame:
    """Per variant: its window, its conservation window if given, rows at the very position, and its overlapping elements by start (the first ``k`` if given)."""
    from spanframe.operators.overlap import as_interval
    from spanframe.operators.topk import top_k_per_group

    base = variants.select("variant_id", *KEYS, "pos")
    placed = _window_of(base, windows)
    if conservation is not None:
        placed = _window_of(placed, conservation)
    exact = base.join(known.select(*KEYS, "pos", "label"), [*KEYS, "pos"]).groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("n_known"), F.min("label").alias("first_label"))
    over = overlap_join(as_interval(base), elements.select(*KEYS, "start_pos", "end_pos", "element_id"), levels=levels)
    if k is not None:
        over = top_k_per_group(over, ["variant_id"], [F.col("b_start_pos"), F.col("b_element_id")], k, "_r")
    packed = over.groupBy("variant_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("b_start_pos", "b_element_id"))), lambda s: s["b_element_id"]).alias("elements"))
    return placed.join(exact, "variant_id", "left").join(packed, "variant_id", "left").fillna(0, ["n_known"])



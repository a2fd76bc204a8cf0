"""Row-local classifications and scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanframe.functions import constants as K


def gc_band(gc: Column) -> Column:
    """Isochore family from the GC fraction."""
    # Upper GC limits of the bands.
    return (
        F.when(gc < 0.37, "L1").when(gc < 0.41, "L2").when(gc < 0.46, "H1").when(gc < 0.53, "H2").when(gc >= 0.53, "H3")
    )


def fragility_level(score: Column) -> Column:
    return F.when(score >= 0.8, "extreme").when(score >= 0.6, "high").when(score >= 0.3, "moderate").otherwise("low")


def site_context(pos: Column, island_start: Column, island_end: Column) -> Column:
    """Island, shore or shelf of a site, given its nearest island (nulls: open sea)."""
    upstream = island_start - pos
    downstream = pos - island_end + 1
    return (
        F.when(island_start.isNull(), "open_sea")
        .when((pos >= island_start) & (pos < island_end), "island")
        .when((pos < island_start) & (upstream <= K.SHORE_DISTANCE), "n_shore")
        .when((pos < island_start) & (upstream <= K.SHELF_DISTANCE), "n_shelf")
        .when((pos >= island_end) & (downstream <= K.SHORE_DISTANCE), "s_shore")
        .when((pos >= island_end) & (downstream <= K.SHELF_DISTANCE), "s_shelf")
        .otherwise("open_sea")
    )


def repeat_age(name: Column, repeat_class: Column, family: Column) -> Column:
    """Age group of a repeat from its name, class and family; first match wins."""
    # Name patterns per class.
    line, sine, ltr = repeat_class == "LINE", repeat_class == "SINE", repeat_class == "LTR"
    return (
        F.when(line & name.rlike("^L1HS$|^L1PA[0-9]"), "young")
        .when(line & name.rlike("^L1PB"), "intermediate")
        .when(line & name.rlike("^(L1M|L2|L3|CR1)"), "ancient")
        .when(sine & name.rlike("^AluY"), "young")
        .when(sine & name.rlike("^AluS"), "intermediate")
        .when(sine & name.rlike("^(AluJ|MIR)"), "ancient")
        .when(ltr & name.rlike("^(HERV-K|LTR5)"), "young")
        .when(ltr & family.isin("ERV1", "ERVK"), "intermediate")
        .when(ltr & family.isin("ERVL", "ERVL-MaLR"), "ancient")
        .when(repeat_class == "DNA", "ancient")
    )


def divergence_age_my(divergence_pct: Column) -> Column:
    """Age in million years from percent divergence at 2.2e-9 changes per site and year."""
    return divergence_pct / 100.0 / (2 * 2.2e-9) / 1e6


def divergence_age_group(age_my: Column) -> Column:
    return F.when(age_my > 100, "ancient").when(age_my > 25, "old").when(age_my > 5, "recent").when(
        age_my.isNotNull(), "young"
    )


def persistence_length(gc: Column) -> Column:
    """Persistence length in nm from the GC fraction."""
    return 49.0 + 43.75 * (gc - 0.30)


def reactivation_score(repeat_class: Column, divergence_pct: Column) -> Column:
    base = F.lit(K.REACTIVATION_DEFAULT)
    for name, value in K.REACTIVATION_BASE.items():
        base = F.when(repeat_class == name, F.lit(value)).otherwise(base)
    age_factor = F.greatest(F.lit(0.0), 1.0 - divergence_pct / 40.0)
    return F.least(F.lit(1.0), base * (0.5 + 0.5 * age_factor))


def silencing(repeat_class: Column) -> Column:
    """Struct (primary, confidence) of the silencing heuristic."""
    out = F.struct(F.lit(K.SILENCING_DEFAULT[0]).alias("primary"), F.lit(K.SILENCING_DEFAULT[1]).alias("confidence"))
    for name, (primary, confidence) in K.SILENCING.items():
        out = F.when(
            repeat_class == name, F.struct(F.lit(primary).alias("primary"), F.lit(confidence).alias("confidence"))
        ).otherwise(out)
    return out


def reactivation_contexts(repeat_class: Column, family: Column) -> Column:
    # Contexts per class.
    ltr = F.when(
        F.upper(family).contains("ERV"), F.array(*map(F.lit, ("aging", "dnmti", "tet2_lof", "setdb1_lof")))
    ).otherwise(F.array(F.lit("aging"), F.lit("dnmti")))
    return (
        F.when(repeat_class == "LTR", ltr)
        .when(repeat_class == "LINE", F.array(F.lit("aging"), F.lit("dnmti")))
        .when(repeat_class == "SINE", F.array(F.lit("aging")))
        .otherwise(F.array().cast("array<string>"))
    )


def risk_level(risk: Column) -> Column:
    return F.when(risk < 0.1, "low").when(risk < 0.25, "moderate").when(risk < 0.4, "elevated").otherwise("high")


def degradation_rate(half_life_hours: Column) -> Column:
    return F.lit(0.6931471805599453) / half_life_hours


def cohens_d(mean_1: Column, sd_1: Column, n_1: Column, mean_2: Column, sd_2: Column, n_2: Column) -> Column:
    """Effect size with pooled sd; null under two values in a group or without variance."""
    pooled = ((n_1 - 1) * sd_1 * sd_1 + (n_2 - 1) * sd_2 * sd_2) / (n_1 + n_2 - 2)
    return F.when((n_1 >= 2) & (n_2 >= 2) & (pooled > 0), (mean_1 - mean_2) / F.sqrt(pooled))

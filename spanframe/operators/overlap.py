"""Overlap joins and overlap counts between interval tables.

Intervals are half-open ``[start_pos, end_pos)`` on the key columns
(``build``, ``chr_id``). Joins run as equi-joins on position bins, so Spark
hashes, sorts and (with adaptive execution) splits hot bins; a pair is kept
only in the bin that holds the later of the two starts, which makes pairs
unique without a distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.operators.scan import running

KEYS = ("build", "chr_id")
#: Bin widths from 64 bases up by fours; a feature's own length picks its level.
LADDER = tuple(64 << 2 * k for k in range(14))


def as_interval(df: DataFrame, pos: str = "pos", width: int = 1) -> DataFrame:
    """Point layer to interval layer."""
    return df.withColumns(
        {"start_pos": F.col(pos).cast("long"), "end_pos": (F.col(pos) + F.lit(width)).cast("long")}
    )


def _home(levels: Sequence[int]) -> Column:
    """Number of the narrowest level that a feature fits into (the widest one for what fits nowhere)."""
    length = F.col("end_pos") - F.col("start_pos")
    home = F.lit(len(levels) - 1)
    for level in reversed(range(len(levels) - 1)):
        home = F.when(length <= levels[level], F.lit(level)).otherwise(home)
    return home


def levels_present(df: DataFrame, levels: Sequence[int] = LADDER) -> Column:
    """Levels on which a side has features: one short array, computed inside the plan that uses it."""
    return df.agg(F.array_sort(F.collect_set(_home(levels)))).scalar()


def _binned(df: DataFrame, levels: Sequence[int], others: Column, probe: bool) -> DataFrame:
    """Explode a side into (role, level, bin) rows.

    A feature lives at its own level (two bins at most) and is looked up at those
    levels above where the other side has features. Role 0 matches two residents;
    role 1 a resident of the left side with a lookup of the right side; role 2 the
    mirror image.
    """
    home_role, lookup_role = (1, 2) if probe else (2, 1)
    home = F.col("_home")

    def spot(role: int, level: Column) -> Column:
        return F.struct(F.lit(role).alias("_role"), level.alias("_level"))

    at_home = F.array_compact(F.array(
        F.when(F.array_contains(F.col("_others"), home), spot(0, home)),
        F.when(F.array_min("_others") < home, spot(home_role, home)),
    ))
    above = F.transform(F.filter("_others", lambda level: level > home), lambda level: spot(lookup_role, level))
    placed = df.withColumns({"_home": _home(levels), "_others": others}).select(*df.columns, F.inline(F.concat(at_home, above)))
    size = _width(levels)
    first = F.floor(F.col("start_pos") / size).cast("long")
    last = F.floor((F.col("end_pos") - 1) / size).cast("long")
    return placed.withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, last))))


def _width(levels: Sequence[int]) -> Column:
    return F.element_at(F.array(*[F.lit(s).cast("long") for s in levels]), F.col("_level") + 1)


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = KEYS,
    levels: list[int] | None = None,
    prefix: str = "b_",
    contained: bool = False,
    length: int | None = None,
) -> DataFrame:
    """All pairs of overlapping intervals.

    Columns of ``b`` other than the keys come back as ``prefix + name``. With
    ``contained`` only pairs with ``a`` inside ``b`` are kept. Bin widths are
    those of ``LADDER``, or ``levels`` where the range of lengths is known;
    ``length`` is that of every interval of ``a`` where they are alike (points).
    """
    keys = list(keys)
    if levels is None:
        levels, of_b = LADDER, levels_present(b)
        of_a = levels_present(a) if length is None else F.array(F.lit(next(i for i, size in enumerate(LADDER) if length <= size)))
    else:
        of_a = of_b = F.array(*[F.lit(i) for i in range(len(levels))])
    left = _binned(a, levels, of_b, True)
    right = _binned(b, levels, of_a, False)
    right = right.select(*[F.col(c) if c in keys or c.startswith("_") else F.col(c).alias(prefix + c)
                           for c in right.columns])
    b_start, b_end = F.col(prefix + "start_pos"), F.col(prefix + "end_pos")
    pairs = left.join(right, [*keys, "_role", "_level", "_bin"])
    owner = F.floor(F.greatest(F.col("start_pos"), b_start) / _width(levels))
    keep = (F.col("start_pos") < b_end) & (b_start < F.col("end_pos")) & (F.col("_bin") == owner)
    if contained:
        keep = keep & (b_start <= F.col("start_pos")) & (F.col("end_pos") <= b_end)
    return pairs.where(keep).drop("_role", "_level", "_bin")


def overlap_length(prefix: str = "b_") -> Column:
    return F.least(F.col("end_pos"), F.col(prefix + "end_pos")) - F.greatest(
        F.col("start_pos"), F.col(prefix + "start_pos")
    )


def count_overlaps(
    regions: DataFrame, layer: DataFrame, keys: Sequence[str] = KEYS, out: str = "n_overlaps", chunk: int = 1 << 16
) -> DataFrame:
    """Number of layer features overlapping each region, without building pairs.

    The count is (features starting before the region's end) minus (features
    ending at or before its start); both are running totals over positions, so
    the work does not grow with the number of overlapping pairs.
    """
    keys = list(keys)
    marks = layer.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("start_pos").cast("long").alias("_at"), F.lit(1).alias("_s"), F.lit(0).alias("_e")),
                F.struct(F.col("end_pos").cast("long").alias("_at"), F.lit(0).alias("_s"), F.lit(1).alias("_e")),
            )
        ),
    )
    asks = regions.select(
        *keys,
        F.explode(F.array(F.col("start_pos").cast("long"), F.col("end_pos").cast("long"))).alias("_at"),
        F.lit(0).alias("_s"),
        F.lit(0).alias("_e"),
    )
    steps = marks.unionByName(asks).groupBy(*keys, "_at").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"))
    # Both sides read one pair of totals, so the scan is planned the same twice and its shuffles are reused.
    totals = running(steps, keys, "_at", {"_started": ("sum", "_s"), "_ended": ("sum", "_e")}, chunk).select(
        *keys, "_at", F.array(F.col("_started") - F.col("_s"), F.col("_ended")).alias("_t")
    )
    at_end = totals.select(*keys, F.col("_at").alias("end_pos"), F.col("_t").alias("_te"))
    at_start = totals.select(*keys, F.col("_at").alias("start_pos"), F.col("_t").alias("_ts"))
    return (
        regions.join(at_end, [*keys, "end_pos"], "left")
        .join(at_start, [*keys, "start_pos"], "left")
        .withColumn(out, (F.coalesce(F.get("_te", F.lit(0)), F.lit(0)) - F.coalesce(F.get("_ts", F.lit(1)), F.lit(0))).cast("long"))
        .drop("_te", "_ts")
    )


def point_overlap_best(
    points: DataFrame, intervals: DataFrame, identity: Sequence[str], score: str, levels: list[int] | None = None
) -> DataFrame:
    """Each point's best overlapping interval by ``score`` (nulls last), ties by start and end."""
    pairs = overlap_join(as_interval(points), intervals, levels=levels, length=1)
    return best_per(
        pairs, identity, [F.col("b_" + score).desc_nulls_last(), F.col("b_start_pos"), F.col("b_end_pos")]
    )


def best_per(df: DataFrame, keys: Sequence[str], order: list) -> DataFrame:
    """First row per key in the given total order (PostgreSQL's DISTINCT ON)."""
    from spanframe.operators.topk import top_k_per_group

    return top_k_per_group(df, keys, order, 1)


def reciprocal_overlap(
    a: DataFrame, b: DataFrame, fraction: float = 0.5, keys: Sequence[str] = KEYS, levels: list[int] | None = None
) -> DataFrame:
    """Pairs whose overlap covers at least ``fraction`` of both features."""
    pairs = overlap_join(a, b, keys, levels)
    shared = overlap_length()
    return pairs.where(
        (shared >= fraction * (F.col("end_pos") - F.col("start_pos")))
        & (shared >= fraction * (F.col("b_end_pos") - F.col("b_start_pos")))
    )


def match_quality(
    computed: DataFrame, truth: DataFrame, fraction: float = 0.5, keys: Sequence[str] = KEYS,
    levels: list[int] | None = None,
) -> DataFrame:
    """Precision and recall of one interval set against another by reciprocal overlap."""
    keys = list(keys)
    place = [*keys, "start_pos", "end_pos"]
    pairs = reciprocal_overlap(computed, truth, fraction, keys, levels)
    hit_a = pairs.select(*place).distinct()
    hit_b = pairs.select(*keys, F.col("b_start_pos").alias("start_pos"), F.col("b_end_pos").alias("end_pos")).distinct()
    side = lambda df, hits, name: (
        df.join(hits.withColumn("_hit", F.lit(1)), place, "left")
        .agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hit"))
        .select(F.lit(name).alias("side"), "n", "hit")
    )
    both = side(computed, hit_a, "computed").unionByName(side(truth, hit_b, "truth"))
    return both.withColumn("fraction", F.when(F.col("n") > 0, F.col("hit") / F.col("n")))


def signal_over_regions(
    signal: DataFrame, regions: DataFrame, identity: Sequence[str], score: str = "score", levels=None
) -> DataFrame:
    """Mean and max signal per region; null where nothing overlaps."""
    pairs = overlap_join(regions, signal, levels=levels)
    stats = pairs.groupBy(*identity).agg(
        F.avg("b_" + score).alias("mean_signal"), F.max("b_" + score).alias("max_signal")
    )
    return regions.join(stats, list(identity), "left")


def containing_value(windows: DataFrame, intervals: DataFrame, value: str, out: str, levels=None) -> DataFrame:
    """Value of the interval that contains each window (largest start wins), left join."""
    keys = [*KEYS, "start_pos"]
    inside = overlap_join(windows.select(*KEYS, "start_pos", "end_pos"), intervals, levels=levels, contained=True)
    pick = inside.groupBy(*keys).agg(
        F.max(F.struct("b_start_pos", "b_end_pos", F.col("b_" + value).alias("v")))["v"].alias(out)
    )
    return windows.join(pick, keys, "left")


def count_overlaps_of_genes(genes: DataFrame, layer: DataFrame, promoter: int = 2000) -> DataFrame:
    """Per gene: promoter overlap count, promoter flag (TSS +-500) and body density per kb."""
    tss = F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos"))
    frames = {
        "near": (tss - 500, tss + 500),
        "promoter": (tss - promoter, tss + promoter),
        "body": (F.col("start_pos"), F.col("end_pos")),
    }
    spots = genes.select(
        *KEYS,
        "gene_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("frame"), lo.alias("start_pos"), hi.alias("end_pos"))
                    for name, (lo, hi) in frames.items()
                ]
            )
        ),
    )
    counted = count_overlaps(spots, layer)
    wide = counted.groupBy("gene_id").agg(
        *[F.max(F.when(F.col("frame") == name, F.col("n_overlaps"))).alias(f"n_{name}") for name in frames],
        F.max(F.when(F.col("frame") == "body", F.col("end_pos") - F.col("start_pos"))).alias("_bp"),
    )
    return wide.select(
        "gene_id",
        (F.col("n_near") > 0).cast("int").alias("near_flag"),
        F.col("n_promoter").alias("promoter_count"),
        (F.col("n_body") / (F.col("_bp") / 1000.0)).alias("body_density"),
    )

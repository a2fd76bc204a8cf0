"""Mapping intervals between builds through a table of aligned blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.operators.overlap import KEYS, overlap_join


def lift_intervals(
    df: DataFrame, blocks: DataFrame, identity: Sequence[str], levels: list[int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Shift each interval by the block that contains it; returns (mapped, unmapped).

    ``blocks`` has the source interval plus ``dst_chr_id`` and ``offset``. An
    interval inside several blocks takes the one with the smallest start.
    """
    inside = overlap_join(df, blocks, levels=levels, contained=True)
    pick = inside.groupBy(*identity).agg(
        F.min(F.struct("b_start_pos", "b_end_pos", "b_dst_chr_id", "b_offset")).alias("_m")
    )
    mapped = df.join(pick, list(identity)).select(
        *[c for c in df.columns if c not in ("chr_id", "start_pos", "end_pos")],
        F.col("_m.b_dst_chr_id").alias("chr_id"),
        (F.col("start_pos") + F.col("_m.b_offset")).alias("start_pos"),
        (F.col("end_pos") + F.col("_m.b_offset")).alias("end_pos"),
    )
    return mapped, df.join(pick, list(identity), "left_anti")


def recurrence_count(
    hits: DataFrame, blocks: DataFrame, levels: list[int] | None = None, least: int = 50_000, most: int = 200_000
) -> DataFrame:
    """Tissues per window, with both window ends lifted; windows that break apart are dropped.

    ``hits`` has (build, chr_id, start_pos, end_pos, tissue). A window counts as whole if its ends lie on one chromosome,
    ``least`` to ``most`` bases apart.
    """
    window = [*KEYS, "start_pos", "end_pos"]
    windows = (
        hits.select(*window, "tissue")
        .distinct()
        .groupBy(*window)
        .agg(F.count(F.lit(1)).alias("n_tissues"), F.array_sort(F.collect_set("tissue")).alias("tissues"))
    )
    ends = windows.select(
        *KEYS,
        F.col("start_pos").alias("w_start"),
        F.col("end_pos").alias("w_end"),
        F.inline(
            F.array(
                F.struct(F.lit("lo").alias("side"), F.col("start_pos").alias("p")),
                F.struct(F.lit("hi").alias("side"), (F.col("end_pos") - 1).alias("p")),
            )
        ),
    ).select(
        *KEYS, F.col("chr_id").alias("w_chr"), "w_start", "w_end", "side",
        F.col("p").alias("start_pos"), (F.col("p") + 1).alias("end_pos"),
    )
    identity = ["build", "w_chr", "w_start", "w_end", "side"]
    mapped, _ = lift_intervals(ends, blocks, identity, levels)
    pair = mapped.groupBy("build", "w_chr", "w_start", "w_end").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("chr_id").alias("_c1"),
        F.max("chr_id").alias("_c2"),
        F.max(F.when(F.col("side") == "lo", F.col("start_pos"))).alias("lifted_start"),
        F.max(F.when(F.col("side") == "hi", F.col("end_pos"))).alias("lifted_end"),
    )
    length = F.col("lifted_end") - F.col("lifted_start")
    kept = pair.where((F.col("_n") == 2) & (F.col("_c1") == F.col("_c2")) & length.between(least, most))
    return (
        windows.withColumnsRenamed({"chr_id": "w_chr", "start_pos": "w_start", "end_pos": "w_end"})
        .join(kept, ["build", "w_chr", "w_start", "w_end"])
        .select(
            "build", F.col("_c1").alias("chr_id"), "lifted_start", "lifted_end", "w_start", "w_end", "n_tissues",
            "tissues",
        )
    )

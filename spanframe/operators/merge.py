"""Interval merging (gaps and islands) with bounded tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.operators.overlap import KEYS
from spanframe.operators.scan import running


def merge_intervals(df: DataFrame, gap: int = 0, keys: Sequence[str] = KEYS, chunk: int = 1 << 16) -> DataFrame:
    """Join intervals whose start lies within ``gap`` of the furthest end so far.

    Intervals sharing a start collapse first. A merged island is named by its
    first start, the running maximum of island-opening starts, so both passes
    are chunked scans and the final groupBy pre-aggregates on the map side.
    """
    keys = list(keys)
    starts = df.groupBy(*keys, F.col("start_pos").cast("long").alias("start_pos")).agg(
        F.max(F.col("end_pos").cast("long")).alias("end_pos"), F.count(F.lit(1)).alias("n")
    )
    reached = running(starts, keys, "start_pos", {"_reach": ("max", "end_pos")}, chunk, inclusive=False)
    opens = F.col("_reach").isNull() | (F.col("start_pos") - F.col("_reach") > gap)
    flagged = reached.withColumn("_open", F.when(opens, F.col("start_pos"))).drop("_reach")
    named = running(flagged, keys, "start_pos", {"_island": ("max", "_open")}, chunk)
    return (
        named.groupBy(*keys, F.col("_island").alias("start_pos"))
        .agg(F.max("end_pos").alias("end_pos"), F.sum("n").alias("n_merged"))
    )

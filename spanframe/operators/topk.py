"""Top-k, first-per-key and ordered deduplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.constants import MAPPING_METHODS


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. The rank filter turns into a group limit before the
    shuffle, so a hot key ships at most ``k`` rows per input task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def distinct_on(df: DataFrame, keys: Sequence[str], order: list) -> DataFrame:
    return top_k_per_group(df, keys, order, 1)


def method_priority(method: Column) -> Column:
    """Position of a mapping method in the fixed best-first order."""
    out = F.lit(len(MAPPING_METHODS))
    for i, name in enumerate(MAPPING_METHODS):
        out = F.when(method == name, F.lit(i)).otherwise(out)
    return out


def dedup_by_priority(df: DataFrame, keys: Sequence[str], method: str = "method", tie: str = "id") -> DataFrame:
    """One edge per key: best method first, then the smallest id."""
    return top_k_per_group(df, keys, [method_priority(F.col(method)), F.col(tie)], 1)


def global_top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def lead_variant(df: DataFrame, keys: Sequence[str], p_value: str, line: str) -> DataFrame:
    """Smallest p per key; the earliest line wins a tie."""
    return top_k_per_group(df, keys, [F.col(p_value).asc_nulls_last(), F.col(line)], 1)


def page_after(df: DataFrame, cursor: tuple | None, size: int, keys: Sequence[str] = ("pos", "id")) -> DataFrame:
    """The ``size`` rows after the cursor in the order of ``keys``; None for the first page.

    The keys together are unique (a position and an id), so pages meet every row once, ties in position included.
    """
    if cursor is not None:
        after = F.lit(False)
        for i, value in enumerate(cursor):
            same = [F.col(k) == v for k, v in zip(keys[:i], cursor)]
            after = after | reduce(and_, same, F.col(keys[i]) > F.lit(value))
        df = df.where(after)
    return df.orderBy(*keys).limit(size)

"""Nearest-feature lookups as ordered scans: points and features share one order of positions, and running values that carry a whole feature look left and right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.classify import site_context
from spanframe.operators.overlap import KEYS, overlap_join
from spanframe.operators.scan import running
from spanframe.operators.topk import top_k_per_group


def _nearest_start(points: DataFrame, intervals: DataFrame, keys: list[str], fields: list[str], radius: int, chunk: int) -> DataFrame:
    """``points`` with ``_best``: distance, then the fields of the interval with the closest start among those that start in reach; null without one.

    Of intervals with one start, the first by the other fields stands for all, so a position is one row; a running maximum carries the last start at or
    before a position with its interval, a running minimum from the other end the next one.
    """
    start, rest = F.col("start_pos").cast("long"), [F.col(c) for c in fields[1:]]
    marks = intervals.select(*keys, start.alias("_at"), F.struct(start.alias("start_pos"), *rest).alias("_f"))
    asks = points.select(*keys, F.col("pos").cast("long").alias("_at")).distinct().withColumn("_f", F.lit(None).cast(marks.schema["_f"].dataType))
    steps = marks.unionByName(asks).groupBy(*keys, "_at").agg(F.min("_f").alias("_f"))
    seen = running(steps, keys, "_at", {"_left": ("max", "_f")}, chunk)
    seen = running(seen, keys, "_at", {"_right": ("min", "_f")}, chunk, reverse=True).select(*keys, F.col("_at").alias("pos"), "_left", "_right")
    pos = F.col("pos")
    scored = lambda side, ok: F.when(ok, F.struct(F.abs(F.col(side)["start_pos"] - pos).alias("distance"), *[F.col(side)[c].alias(c) for c in fields]))
    left = scored("_left", (F.col("_left")["start_pos"] > pos - radius) | ((F.col("_left")["start_pos"] == pos - radius) & (F.col("_left")["end_pos"] > pos - radius)))
    right = scored("_right", F.col("_right")["start_pos"] < pos + radius)
    return points.withColumn("pos", F.col("pos").cast("long")).join(seen, [*keys, "pos"], "left").withColumn("_best", F.least(left, right)).drop("_left", "_right")


def _first_name(points: DataFrame, intervals: DataFrame, identity: list[str], symbol: str, radius: int, levels: list[int] | None) -> DataFrame:
    """(identity, _name): the first name alphabetically among the intervals that touch each point's reach.

    Starts in reach: the axis is cut into blocks as wide as the reach, whose running minima from either end cover any window in two lookups.
    Intervals that start before the reach cover its first base; only those are paired with points.
    """
    named = intervals.where(F.col(symbol).isNotNull()).select(*KEYS, F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), symbol)
    first, last = F.col("pos").cast("long") - radius, F.col("pos").cast("long") + radius - 1
    places = points.select(*identity, *KEYS, F.inline(F.array(F.struct(first.alias("_at"), F.lit(True).alias("_from")), F.struct(last.alias("_at"), F.lit(False).alias("_from")))))
    marks = named.where("end_pos > start_pos").select(*KEYS, F.col("start_pos").alias("_at"), F.col(symbol).alias("_name"))
    nothing = F.lit(None).cast(marks.schema["_name"].dataType)
    steps = marks.unionByName(places.select(*KEYS, "_at").distinct().withColumn("_name", nothing)).groupBy(*KEYS, "_at").agg(F.min("_name").alias("_name"))
    block = F.floor(F.col("_at") / (2 * radius))
    order = Window.partitionBy(*KEYS, "_block").orderBy("_at")
    minima = steps.withColumn("_block", block).withColumns({
        "_upto": F.min("_name").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_onwards": F.min("_name").over(order.rowsBetween(0, Window.unboundedFollowing))})
    near = places.join(minima.select(*KEYS, "_at", "_upto", "_onwards"), [*KEYS, "_at"]).select(*identity, F.when(F.col("_from"), F.col("_onwards")).otherwise(F.col("_upto")).alias("_name"))
    edge = points.select(*identity, *KEYS, first.alias("start_pos"), (first + 1).alias("end_pos"))
    over = overlap_join(edge, named, levels=levels, length=1).select(*identity, F.col("b_" + symbol).alias("_name"))
    return near.unionByName(over).groupBy(*identity).agg(F.min("_name").alias("_name"))


def nearest_within(
    points: DataFrame,
    intervals: DataFrame,
    identity: Sequence[str],
    radius: int,
    order: str = "distance",
    symbol: str | None = None,
    levels: list[int] | None = None,
    chunk: int = 1 << 16,
) -> DataFrame:
    """Closest interval (by start) among those touching ``pos - radius .. pos + radius``.

    ``order="distance"`` sorts by distance of the start, then start, then end, then name;
    ``order="symbol"`` takes the first name alphabetically instead (intervals without one are passed over). Left join:
    points with nothing in reach keep nulls.

    A start in reach is closer than any other, and scans find it without pairs. Only points without one are paired, with the intervals over
    the first base of their reach.
    """
    identity, keys = list(identity), list(KEYS)
    fields = ["start_pos", "end_pos", *([symbol] if symbol else []), *[c for c in intervals.columns if c not in (*KEYS, "start_pos", "end_pos", symbol)]]
    asked = points.select(*dict.fromkeys([*identity, *KEYS, "pos"]))
    wanted = intervals
    if order == "symbol":
        names = _first_name(asked, intervals, identity, symbol, radius, levels).where("_name IS NOT NULL")
        asked = asked.join(names, identity)
        wanted, keys = intervals.withColumn("_name", F.col(symbol)), [*KEYS, "_name"]
    found = _nearest_start(asked, wanted, keys, fields, radius, chunk)
    shown = [F.col("_best")[c].alias("b_" + c) for c in intervals.columns if c not in KEYS]
    near = found.where("_best IS NOT NULL").select(*identity, *shown, F.col("_best")["distance"].alias("distance"))
    far = found.where("_best IS NULL").select(*dict.fromkeys([*identity, *keys]), "pos", (F.col("pos") - radius).alias("start_pos"), (F.col("pos") + radius).alias("end_pos"))
    pairs = overlap_join(far, wanted, keys=keys, levels=levels, length=2 * radius).withColumn("distance", F.abs(F.col("b_start_pos") - F.col("pos")))
    best = top_k_per_group(pairs, identity, [F.col("distance"), *[F.col("b_" + c) for c in fields]], 1)
    return points.join(near.unionByName(best.select(*near.columns)), identity, "left")


def nearest_distance(points: DataFrame, features: DataFrame, keys: Sequence[str] = KEYS, chunk: int = 1 << 16):
    """Distance from ``pos`` to the nearest feature edge, 0 inside (both edges included).

    Positions and features are merged into one ordered table: the largest end of
    all features started so far looks left, the next start looks right.
    """
    keys = list(keys)
    marks = features.select(
        *keys, F.col("start_pos").cast("long").alias("_at"), F.col("end_pos").cast("long").alias("_end"),
        F.col("start_pos").cast("long").alias("_start"),
    )
    asks = points.select(
        *keys, F.col("pos").cast("long").alias("_at"), F.lit(None).cast("long").alias("_end"),
        F.lit(None).cast("long").alias("_start"),
    )
    steps = marks.unionByName(asks).groupBy(*keys, "_at").agg(F.max("_end").alias("_end"), F.max("_start").alias("_start"))
    seen = running(steps, keys, "_at", {"_left": ("max", "_end")}, chunk)
    seen = running(seen, keys, "_at", {"_right": ("min", "_start")}, chunk, reverse=True)
    pos = F.col("pos")
    left = F.when(F.col("_left") >= pos, F.lit(0)).otherwise(pos - F.col("_left"))
    right = F.col("_right") - pos
    near = seen.select(*keys, F.col("_at").alias("pos"), "_left", "_right")
    return (
        points.withColumn("pos", F.col("pos").cast("long"))
        .join(near, [*keys, "pos"], "left")
        .withColumn("distance", F.least(left, right))
        .drop("_left", "_right")
    )


def classify_sites(
    sites: DataFrame, islands: DataFrame, identity: Sequence[str], levels: list[int] | None = None
) -> DataFrame:
    """Island, shore, shelf or open sea for every site, from its nearest island within 4 kb."""
    found = nearest_within(sites, islands.select(*KEYS, "start_pos", "end_pos"), identity, K.SHELF_DISTANCE + 1, levels=levels)
    return found.withColumn(
        "context", site_context(F.col("pos"), F.col("b_start_pos"), F.col("b_end_pos"))
    ).drop("b_start_pos", "b_end_pos", "distance")

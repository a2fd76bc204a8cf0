"""Coordinate expressions: region text, 1-based/0-based conversion, tiles and bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.constants import CHROMOSOME_IDS

REGION_PATTERN = r"^(chr[0-9XYM]{1,2}):([0-9]+)-([0-9]+)$"
RESOLUTIONS = (1_000, 10_000, 100_000, 1_000_000)


def bin_start(pos: Column, size: int) -> Column:
    """Start of the fixed-size bin that holds ``pos``."""
    return (F.floor(pos / F.lit(size)) * F.lit(size)).cast("long")


def chromosome_id(name: Column) -> Column:
    """Chromosome name to id; unknown names give null."""
    table = F.create_map(*[F.lit(x) for kv in CHROMOSOME_IDS.items() for x in kv])
    return F.try_element_at(table, name).cast("int")


def with_chr_prefix(name: Column) -> Column:
    return F.when(name.startswith("chr"), name).otherwise(F.concat(F.lit("chr"), name))


def to_internal(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """1-based closed to 0-based half-open, with the width."""
    return df.withColumns(
        {
            "start_pos": (F.col(start) - 1).cast("long"),
            "end_pos": F.col(end).cast("long"),
            "width": (F.col(end) - F.col(start) + 1).cast("long"),
        }
    )


def to_external(df: DataFrame, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """0-based half-open to 1-based closed."""
    return df.withColumns({"start": (F.col(start) + 1).cast("long"), "end": F.col(end).cast("long")})


def parse_regions(df: DataFrame, column: str = "region") -> DataFrame:
    """``chrN:start-end`` text to typed internal coordinates.

    Bad text does not fail the job: ``reject`` names the reason and the typed
    columns are null.
    """
    text = F.col(column)
    chrom = F.regexp_extract(text, REGION_PATTERN, 1)
    start = F.regexp_extract(text, REGION_PATTERN, 2).try_cast("long")
    end = F.regexp_extract(text, REGION_PATTERN, 3).try_cast("long")
    parsed = df.withColumns({"_chr": chrom, "_s": start, "_e": end})
    reject = (
        F.when(text.isNull() | (F.col("_chr") == ""), F.lit("format"))
        .when(F.col("_s").isNull() | F.col("_e").isNull(), F.lit("format"))
        .when(F.col("_s") > F.col("_e"), F.lit("order"))
        .when(chromosome_id(F.col("_chr")).isNull(), F.lit("chromosome"))
    )
    parsed = parsed.withColumn("reject", reject)
    ok = F.col("reject").isNull()
    return parsed.withColumns(
        {
            "chr_id": F.when(ok, chromosome_id(F.col("_chr"))),
            "start_pos": F.when(ok, F.col("_s") - 1),
            "end_pos": F.when(ok, F.col("_e")),
        }
    ).drop("_chr", "_s", "_e")


def tile_index(pos: Column, size: int) -> Column:
    return F.floor(pos / F.lit(size)).cast("long")


def tiles_of_region(df: DataFrame, size: int, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """One row per tile a region touches, with the tile's own coordinates."""
    tiles = F.sequence(tile_index(F.col(start), size), tile_index(F.col(end) - 1, size))
    return df.withColumn("tile", F.explode(tiles)).withColumns(
        {"tile_start": F.col("tile") * size, "tile_end": (F.col("tile") + 1) * size}
    )


def field_predicate(field: str, op: str, value=None, allowed: tuple[str, ...] | None = None) -> Column:
    """Comparison named by text, over an allow-list of fields.

    ``overlaps`` selects every row; ``between`` takes a pair, both ends included.
    """
    if op == "overlaps":
        return F.lit(True)
    if allowed is not None and field not in allowed:
        raise ValueError(f"field {field!r} cannot be filtered; choose from {sorted(allowed)}")
    column = F.col(field)
    if op == "between":
        low, high = value
        return column.between(low, high)
    comparisons = {
        ">": column > value,
        "<": column < value,
        ">=": column >= value,
        "<=": column <= value,
        "==": column == value,
        "!=": column != value,
    }
    if op not in comparisons:
        raise ValueError(f"unknown operator {op!r}")
    return comparisons[op]


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def round_to(column: Column, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0."""
    return F.round(column, digits) + F.lit(0.0)

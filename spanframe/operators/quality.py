"""Data-quality checks, content digests and the layer catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.stats import safe_corr


def content_hash(df: DataFrame) -> DataFrame:
    """One SHA-256 over all rows, whatever their order or partitioning.

    Row digests are summed per bucket as numbers (so equal rows still count
    twice) and the bucket sums are digested in bucket order; a bucket is a first byte,
    so only 256 short rows meet in one place.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    rows = df.select(digest.alias("_d")).withColumn("_b", F.substring("_d", 1, 2))
    parts = [F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    sums = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(p).alias(f"_s{i}") for i, p in enumerate(parts)])
    text = F.concat_ws(":", "_b", "_n", *[f"_s{i}" for i in range(8)])
    return sums.agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "|"), 256).alias("content_hash"), F.sum("_n").alias("row_count")
    )


def active_layers(layers: DataFrame) -> DataFrame:
    return layers.where(F.col("is_active") & F.col("is_default"))


def list_layers(layers: DataFrame, **filters) -> DataFrame:
    """Active default layers matching the given column values, in key order."""
    out = active_layers(layers)
    for field, value in filters.items():
        if value is not None:
            out = out.where(F.col(field) == value)
    return out.orderBy("layer_key", "version")


def register_layer(layers: DataFrame, entry: DataFrame) -> DataFrame:
    """Upsert by (layer_key, version, genome_build); the newest version of a key is its default."""
    key = ["layer_key", "version", "genome_build"]
    merged = layers.join(entry.select(*key), key, "left_anti").unionByName(entry, allowMissingColumns=True)
    newest = Window.partitionBy("layer_key", "genome_build").orderBy(F.col("version").desc())
    return merged.withColumn("is_default", F.row_number().over(newest) == 1)


def assert_base_rows(df: DataFrame, minimum: int, what: str = "layer") -> DataFrame:
    """Fail when the table is too small to derive from; otherwise pass it on."""
    found = df.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"{what} has {found} rows; at least {minimum} are needed")
    return df


def assert_updated(before: DataFrame, staging: DataFrame, keys: list[str], minimum_share: float = 0.0) -> int:
    """Rows of ``before`` that staging touches; fails when none (or too small a share) match."""
    total = before.count()
    hit = before.select(*keys).join(staging.select(*keys).distinct(), keys, "left_semi").count()
    if hit == 0 or hit < minimum_share * total:
        raise ValueError(f"staging matches {hit} of {total} rows")
    return hit


def check_layer(df: DataFrame, min_rows: int, fields: dict[str, dict]) -> DataFrame:
    """Long report of all rules in one pass: row count, value range and null share per field.

    ``fields`` maps a field to ``{low, high, max_null}``; any part may be missing.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, (name, rule) in enumerate(fields.items()):
        value = F.col(name)
        outside = F.lit(False)
        if rule.get("low") is not None:
            outside = outside | (value < rule["low"])
        if rule.get("high") is not None:
            outside = outside | (value > rule["high"])
        aggs += [F.count_if(outside).alias(f"_o{i}"), F.count_if(value.isNull()).alias(f"_u{i}")]
    one = df.agg(*aggs)
    row = lambda check, field, value, ok: F.struct(
        F.lit(check).alias("check"), F.lit(field).alias("field"), value.cast("double").alias("value"), ok.alias("passed"))
    rows = [row("row_count", "*", F.col("_n"), F.col("_n") >= min_rows)]
    for i, (name, rule) in enumerate(fields.items()):
        share = F.coalesce(F.try_divide(F.col(f"_u{i}"), F.col("_n")), F.lit(0.0))
        rows.append(row("value_range", name, F.col(f"_o{i}"), F.col(f"_o{i}") == 0))
        rows.append(row("null_fraction", name, share, share <= rule.get("max_null", 1.0)))
    return one.select(F.inline(F.array(*rows)))


def check_cross_fields(df: DataFrame, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """Declared correlations (x, y, sign, smallest |r|) against the data."""
    one = df.agg(*[safe_corr(F.col(x), F.col(y)).alias(f"_r{i}") for i, (x, y, _, _) in enumerate(rules)])
    cells = []
    for i, (x, y, sign, least) in enumerate(rules):
        r = F.col(f"_r{i}")
        ok = ((r > 0) if sign == "+" else (r < 0)) & (F.abs(r) >= least)
        cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), r.alias("r"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return one.select(F.inline(F.array(*cells)))


def null_audit(df: DataFrame, warn: float = 0.5) -> DataFrame:
    """Null share per column with a level."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).alias("null_fraction")) for c in df.columns]
    level = F.when(F.col("null_fraction") > warn, "warning").when(F.col("null_fraction") > 0, "some").otherwise("none")
    return one.select(F.inline(F.array(*cells))).withColumn("level", level)

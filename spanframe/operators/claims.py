"""Claims: boolean trees over named statistics in three-valued logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.stats import safe_corr


def _transform(value: Column, name: Column) -> Column:
    return (
        F.when(name.isNull(), value).when(name == "abs", F.abs(value)).when(name == "neg", -value)
        .when((name == "log") & (value > 0), F.log(value))
    )


def evaluate_comparisons(leaves: DataFrame, stats: DataFrame) -> DataFrame:
    """Truth of each leaf (claim_id, node_id, lhs, lhs_transform, op, rhs, rhs_transform, rhs_value); unknown stays null."""
    left = stats.select(F.col("stat_id").alias("lhs"), F.col("value").alias("_l"))
    right = stats.select(F.col("stat_id").alias("rhs"), F.col("value").alias("_r"))
    joined = leaves.join(left, "lhs", "left").join(right, "rhs", "left")
    a = _transform(F.col("_l"), F.col("lhs_transform"))
    b = F.when(F.col("rhs").isNotNull(), _transform(F.col("_r"), F.col("rhs_transform"))).otherwise(F.col("rhs_value"))
    op = F.col("op")
    truth = (
        F.when(op == "<", a < b).when(op == "<=", a <= b).when(op == "=", a == b).when(op == "!=", a != b)
        .when(op == ">", a > b).when(op == ">=", a >= b)
    )
    return joined.withColumn("truth", truth).drop("_l", "_r")


def evaluate_claims(nodes: DataFrame, leaves: DataFrame, stats: DataFrame, depth: int) -> DataFrame:
    """Verdict per claim: LICENSED, REJECTED or PENDING.

    ``nodes`` holds every tree node (claim_id, node_id, parent_id, kind, level)
    with kind ``cmp``, ``and``, ``or`` or ``not`` and the root at level 0. Each
    level folds into its parents by one aggregation over min/max of truth.
    """
    known = evaluate_comparisons(leaves, stats).select("claim_id", "node_id", "truth")
    for level in range(depth, 0, -1):
        children = nodes.where(F.col("level") == level).join(known, ["claim_id", "node_id"], "left")
        folded = children.groupBy("claim_id", F.col("parent_id").alias("node_id")).agg(
            F.bool_and("truth").alias("_all"), F.bool_or("truth").alias("_any"),
            F.count_if(F.col("truth").isNull()).alias("_unknown"),
        )
        parents = nodes.where((F.col("level") == level - 1) & (F.col("kind") != "cmp")).join(folded, ["claim_id", "node_id"])
        complete = F.col("_unknown") == 0
        truth = (
            F.when(F.col("kind") == "and", F.when(~F.col("_all"), False).when(complete, True))
            .when(F.col("kind") == "or", F.when(F.col("_any"), True).when(complete, False))
            .when(F.col("kind") == "not", ~F.col("_any"))
        )
        known = known.unionByName(parents.select("claim_id", "node_id", truth.alias("truth")))
    root = nodes.where(F.col("level") == 0).join(known, ["claim_id", "node_id"], "left")
    return root.select(
        "claim_id", "truth",
        F.when(F.col("truth"), "LICENSED").when(~F.col("truth"), "REJECTED").otherwise("PENDING").alias("verdict"),
    )


def claim_correlation(layer: DataFrame, features: list[str], response: str) -> DataFrame:
    """Mean absolute Pearson r of the features with the response."""
    cells = [F.abs(safe_corr(F.col(f), F.col(response))).alias(f) for f in features]
    return layer.agg(*cells).select(
        F.aggregate(F.array(*[F.col(f) for f in features]), F.lit(0.0), lambda a, x: a + x,
                    lambda a: a / F.lit(float(len(features)))).alias("mean_abs_r")
    )

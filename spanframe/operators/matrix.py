"""Correlation matrices, partial correlation, PCA, mutual information and stratified effects.

Matrices come back long (x, y, value). A p-column matrix is p(p+1)/2 aggregates
in one pass over the table; only matrix-sized results are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.stats import safe_corr
from spanframe.operators.scan import value_ranks


def _fill_means(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Replace nulls by the column mean (of the group)."""
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    joined = df.join(means, list(by), "left") if by else df.join(F.broadcast(means))  # one row
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols}).drop(*[f"_m_{c}" for c in cols])


def corr_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), min_rows: int = 0, impute: bool = True) -> DataFrame:
    """Pearson matrix over mean-filled columns: (by, x, y, n, r); groups under ``min_rows`` are left out.

    Nulls are filled with the mean of the whole column.
    """
    by = list(by)
    source = _fill_means(df.select(*by, *cols), cols) if impute else df.select(*by, *cols)
    pairs = list(combinations_with_replacement(cols, 2))
    wide = source.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[safe_corr(F.col(x), F.col(y)).alias(f"_r{i}") for i, (x, y) in enumerate(pairs)]
    ).where(F.col("n") >= min_rows)
    cells = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"_r{i}").alias("r")) for i, (x, y) in enumerate(pairs)]
    cells += [F.struct(F.lit(y).alias("x"), F.lit(x).alias("y"), F.col(f"_r{i}").alias("r"))
              for i, (x, y) in enumerate(pairs) if x != y]
    return wide.select(*by, "n", F.inline(F.array(*cells)))


def spearman_matrix(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Pearson matrix over mid-ranks; ``key`` identifies a row.

    All columns are ranked in one pass over (key, column, value) rows and turned back by one aggregation, so the plan does not grow with the columns. Nulls
    have no rank and stay out of the join.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("_column"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(cols)])
    long = df.select(F.col(key).alias("_key"), F.inline(cells))
    ranks = value_ranks(long, ["_column"], "_value").select("_column", "_value", (F.col("n_before") + (F.col("n_at") + 1) / 2.0).alias("_rank"))
    known = long.where("_value IS NOT NULL").join(ranks, ["_column", "_value"]).select("_key", "_column", "_rank")
    every = known.unionByName(long.where("_value IS NULL").select("_key", "_column", F.lit(None).cast("double").alias("_rank")))
    wide = every.groupBy("_key").agg(*[F.max(F.when(F.col("_column") == i, F.col("_rank"))).alias(c) for i, c in enumerate(cols)])
    return corr_matrix(wide.select(*cols), cols)


def partial_corr(r: Column, rx: Column, ry: Column) -> Column:
    """First-order partial correlation; null where the control explains a side fully."""
    denominator = F.sqrt(F.greatest(F.lit(0.0), (1 - rx * rx) * (1 - ry * ry)))
    return F.when(denominator > 1e-10, (r - rx * ry) / denominator)


def partial_corr_matrix(matrix: DataFrame, control: str, by: Sequence[str] = ()) -> DataFrame:
    """Matrix given one column, from the matrix itself joined with its control column twice."""
    by = list(by)
    col = matrix.where(F.col("y") == control)
    left = col.select(*by, "x", F.col("r").alias("_rx"))
    right = col.select(*by, F.col("x").alias("y"), F.col("r").alias("_ry"))
    value = F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(partial_corr(F.col("r"), F.col("_rx"), F.col("_ry")))
    return matrix.join(left, [*by, "x"]).join(right, [*by, "y"]).select(*by, "x", "y", value.alias("partial_r"))


def pca(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """Explained variance share and absolute loadings of the first ``k`` components.

    The fit reads the table; the result is a k x p matrix. Component signs are arbitrary.
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    filled = _fill_means(df.select(*cols), cols)
    vectors = VectorAssembler(inputCols=list(cols), outputCol="v").transform(filled)
    model = PCA(k=k, inputCol="v", outputCol="o").fit(vectors)
    rows = [
        (c + 1, float(model.explainedVariance[c]), name, abs(float(model.pc[i, c])))
        for c in range(k) for i, name in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, field string, abs_loading double")


def mutual_information(df: DataFrame, cols: Sequence[str], bins: int = 50) -> DataFrame:
    """Histogram mutual information (nats) per column pair over equal-width bins."""
    span = df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    binned = df.select(*cols).join(F.broadcast(span))  # one row
    codes = {
        c: F.when(
            F.col(c).isNotNull(),
            F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") + 1e-10 - F.col(f"_lo_{c}")) * bins)),
        ).cast("int")
        for c in cols
    }
    coded = binned.select(*[e.alias(c) for c, e in codes.items()])
    cells = coded.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).alias("a"), F.col(y).alias("b"))
        for x, y in combinations(cols, 2)
    ]))).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    joint = cells.groupBy("x", "y", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    pair = ["x", "y"]
    sums = joint.groupBy(*pair).agg(F.sum("c").alias("n"))
    left = joint.groupBy(*pair, "a").agg(F.sum("c").alias("ca"))
    right = joint.groupBy(*pair, "b").agg(F.sum("c").alias("cb"))
    full = joint.join(sums, pair).join(left, [*pair, "a"]).join(right, [*pair, "b"])
    term = F.col("c") / F.col("n") * F.log(F.col("c").cast("double") * F.col("n") / (F.col("ca").cast("double") * F.col("cb")))
    return full.groupBy(*pair).agg(F.sum(term).alias("mi"))


def distance_correlation(df: DataFrame, x: str, y: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Distance correlation over a seeded sample of ``n`` rows, those with the smallest md5 of ``key|seed`` (the operator is defined on a sample).

    Pairwise distances are n*n by definition; ``n`` bounds them. Row means and
    the products are aggregated from the pair table, keyed by row, never in one task.
    """
    sample = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).orderBy(F.md5(F.concat_ws("|", F.col(key), F.lit(seed))), key).limit(n)
    rows = sample.select(F.col(key).alias("i"), F.col(x).alias("xi"), F.col(y).alias("yi"))
    # Both sides carry every slot of a fixed fan, so pairs spread over the slots by equi-join.
    fan = 8
    left = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))))
    right = rows.select(
        F.col("i").alias("j"), F.col("xi").alias("xj"), F.col("yi").alias("yj"),
        F.pmod(F.xxhash64("i"), F.lit(fan)).cast("int").alias("slot"),
    )
    pairs = left.join(right, "slot").select(
        "i", "j", F.abs(F.col("xi") - F.col("xj")).alias("dx"), F.abs(F.col("yi") - F.col("yj")).alias("dy")
    )
    means = pairs.groupBy("i").agg(F.avg("dx").alias("mx"), F.avg("dy").alias("my"))
    grand = means.agg(F.avg("mx").alias("gx"), F.avg("my").alias("gy"))
    other = means.select(F.col("i").alias("j"), F.col("mx").alias("nx"), F.col("my").alias("ny"))
    centred = pairs.join(means, "i").join(other, "j").join(F.broadcast(grand))  # grand: one row
    a = F.col("dx") - F.col("mx") - F.col("nx") + F.col("gx")
    b = F.col("dy") - F.col("my") - F.col("ny") + F.col("gy")
    sums = centred.agg(F.avg(a * b).alias("xy"), F.avg(a * a).alias("xx"), F.avg(b * b).alias("yy"), F.count(F.lit(1)).alias("n_pairs"))
    value = F.when(
        (F.col("xx") > 0) & (F.col("yy") > 0), F.sqrt(F.greatest(F.lit(0.0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))))
    ).otherwise(0.0)
    return sums.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n_pairs", value.alias("dcor"))


def band_of(value: Column, bands: Sequence[tuple[float, float]]) -> Column:
    """Index of the half-open band holding a value, null outside."""
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(bands):
        out = F.when((value >= low) & (value < high), F.lit(i)).otherwise(out)
    return out


def stratified_partial_corr(df: DataFrame, xs: Sequence[str], y: str, z: str, bands, min_rows: int = 100) -> DataFrame:
    """Per property: mean absolute partial correlation with ``y`` given ``z`` over bands of ``z``, with a verdict."""
    banded = df.withColumn("band", band_of(F.col(z), bands)).where(F.col("band").isNotNull())
    stats = banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), safe_corr(F.col(y), F.col(z)).alias("_yz"),
        *[safe_corr(F.col(x), F.col(y)).alias(f"_xy_{x}") for x in xs],
        *[safe_corr(F.col(x), F.col(z)).alias(f"_xz_{x}") for x in xs],
    ).where(F.col("n") >= min_rows)
    long = stats.select("band", "n", F.inline(F.array(*[
        F.struct(F.lit(x).alias("field"), F.col(f"_xy_{x}").alias("r_raw"),
                 F.coalesce(partial_corr(F.col(f"_xy_{x}"), F.col(f"_xz_{x}"), F.col("_yz")), F.lit(0.0)).alias("partial_r"))
        for x in xs
    ])))
    mean = F.sum(F.abs("partial_r") * F.col("n")) / F.sum("n")
    out = long.groupBy("field").agg(F.count(F.lit(1)).alias("n_bands"), F.sum("n").alias("n"), mean.alias("mean_abs_partial_r"))
    v = F.col("mean_abs_partial_r")
    return out.withColumn(
        "verdict", F.when(v > 0.10, "strong").when(v > 0.05, "weak").when(v > 0.02, "marginal").otherwise("none")
    )


def effect_columns(flag: Column, y: Column) -> dict[str, Column]:
    """n, mean and sd of flagged and unflagged rows."""
    out = {}
    for name, test in (("f", flag), ("u", ~flag)):
        value = F.when(test, y)
        out |= {f"n_{name}": F.count(value), f"m_{name}": F.avg(value), f"s_{name}": F.stddev_samp(value)}
    return out


def stratified_effect(df: DataFrame, flags: Sequence[str], y: str, z: str, bands, min_side: int = 10) -> DataFrame:
    """Cohen's d of each flag: overall, pooled over bands of ``z`` by size, with a 95 % interval."""
    from spanframe.functions.classify import cohens_d

    long = df.select(
        F.col(y).alias("_y"), band_of(F.col(z), bands).alias("band"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).cast("boolean").alias("_on")) for f in flags])),
    ).where(F.col("_y").isNotNull())
    cols = effect_columns(F.col("_on"), F.col("_y"))
    d = cohens_d(*[F.col(c) for c in ("m_f", "s_f", "n_f", "m_u", "s_u", "n_u")])
    named = [c.alias(k) for k, c in cols.items()]
    total = long.groupBy("flag").agg(*named).select("flag", "n_f", "n_u", d.alias("d_raw"))
    inside = long.where(F.col("band").isNotNull()).groupBy("flag", "band").agg(*named).where(
        (F.col("n_f") >= min_side) & (F.col("n_u") >= min_side)
    ).select("flag", d.alias("d"), (F.col("n_f") + F.col("n_u")).alias("n"))
    pooled = inside.groupBy("flag").agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("d_controlled"))
    n1, n2, dc = F.col("n_f"), F.col("n_u"), F.col("d_controlled")
    se = F.sqrt((n1 + n2) / (n1.cast("double") * n2) + dc * dc / (2 * (n1 + n2)))
    return total.where((n1 > 0) & (n2 > 0)).join(pooled, "flag", "left").withColumns(
        {"ci_low": dc - 1.96 * se, "ci_high": dc + 1.96 * se}
    )


def ols(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """Least squares with intercept: coefficient, standard error, t and R2 per term (normal equations)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.select(*xs, F.col(y).alias("_y")).dropna()
    vectors = VectorAssembler(inputCols=list(xs), outputCol="v").transform(rows)
    model = LinearRegression(featuresCol="v", labelCol="_y", solver="normal", regParam=0.0).fit(vectors)
    summary = model.summary
    terms = [*xs, "intercept"]
    values = [*[float(c) for c in model.coefficients], float(model.intercept)]
    table = [
        (t, v, float(se), float(tv), float(summary.r2))
        for t, v, se, tv in zip(terms, values, summary.coefficientStandardErrors, summary.tValues, strict=True)
    ]
    return df.sparkSession.createDataFrame(table, "term string, beta double, se double, t double, r2 double")


def redundancy_verdict(df: DataFrame, cols: Sequence[str], control: str) -> DataFrame:
    """Per property: r with the control, variance left, verdict and number of strong partial partners."""
    matrix = corr_matrix(df, cols)
    base = matrix.where((F.col("y") == control) & (F.col("x") != control))
    left = 1 - F.col("r") * F.col("r")
    partners = partial_corr_matrix(matrix, control).where(
        (F.col("x") != F.col("y")) & (F.col("x") != control) & (F.col("y") != control) & (F.abs("partial_r") > 0.3)
    ).groupBy("x").agg(F.count(F.lit(1)).alias("n_partners"))
    return base.join(partners, "x", "left").select(
        F.col("x").alias("field"), F.col("r").alias("r_control"), left.alias("independent"),
        F.when(left < 0.01, "redundant").when(left < 0.05, "mostly_control").when(left < 0.20, "partly_independent")
        .otherwise("independent").alias("verdict"),
        F.coalesce("n_partners", F.lit(0)).alias("n_partners"),
    )


def components_needed(explained: DataFrame, shares: Sequence[float] = (0.5, 0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """How many components reach each share of variance; ``explained`` has one row per component."""
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(0)).orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    run = explained.select("component", "explained").distinct().withColumn("_c", F.sum("explained").over(order))
    return run.select("component", "_c", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")).where(
        F.col("_c") >= F.col("share") - 1e-12
    ).groupBy("share").agg(F.min("component").alias("n_components"))

"""Exact distance correlation of two columns over all rows, without pairs of rows.

With row sums A_i = sum_j |x_i - x_j| (and B_i), the V-statistic needs only sums of A, B, A B, A A, B B and the sum over pairs of |dx| |dy|. Row sums
are prefix sums in the order of the values. The pair sum is split by buckets of x and of y (ranges of about equal size, ties in one bucket):

* pairs apart in both: the signs are known, so sums of 1, x, y, xy by cell (x bucket, y bucket) and their prefix sums say it all;
* pairs in one x bucket: a merge over the sorted bucket, inside one task;
* pairs in one y bucket, but not in one cell: the same in a y bucket, less its cells.

A value so frequent that it fills a bucket has one of its own: its pairs have no distance on that side, so its rows need not meet and are dealt over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows aimed at in a bucket, most buckets of a side (beyond them buckets grow), and tasks for the rows of one frequent value.
BUCKET_ROWS, MOST_BUCKETS, SHARES = 1 << 16, 4096, 64


def pair_sum(x: np.ndarray, y: np.ndarray) -> float:
    """Sum over all pairs of |dx| |dy| in O(n log^2 n): blocks of the x order merge, and left halves are summed in the order of y."""
    n = len(x)
    if n < 2:
        return 0.0
    order = np.argsort(x, kind="stable")
    x, y = x[order] - x.mean(), y[order] - y.mean()
    by_y = np.argsort(y, kind="stable")
    total, size = 0.0, 1
    while size < n:
        parent = by_y // (2 * size)
        inside = by_y[np.argsort(parent, kind="stable")]  # by parent block, then by y
        block, left = inside // (2 * size), inside // size % 2 == 0
        xs, ys = x[inside], y[inside]
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        own = np.where(left, 1.0, 0.0)
        sums = [np.concatenate([[0.0], np.cumsum(own * v)]) for v in (1.0, xs, ys, xs * ys)]
        last = np.append(first[1:], n)
        right = np.flatnonzero(~left)
        c, sx, sy, sxy = (s[right] - s[first][of[right]] for s in sums)  # left elements with smaller y
        tc, tx, ty, txy = (s[last][of[right]] - s[first][of[right]] for s in sums)
        xr, yr = xs[right], ys[right]
        below = xr * yr * c - xr * sy - yr * sx + sxy
        every = xr * yr * tc - xr * ty - yr * tx + txy
        total += float((2 * below - every).sum())
        size *= 2
    return total


def _cuts(df: DataFrame, value: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of the buckets' ranges (values at or below one belong to it), and which of them hold one frequent value alone."""
    if buckets <= 1:
        return np.zeros(0), np.zeros(0, bool)
    found = np.array(df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], F.lit(20 * buckets))).first()[0] or [], float)
    values, times = np.unique(found, return_counts=True)
    ends, hot = [], []
    for v, k in zip(values.tolist(), times.tolist()):
        if k > 1 and (not ends or ends[-1] < np.nextafter(v, -np.inf)):
            ends.append(np.nextafter(v, -np.inf))
            hot.append(False)
        ends.append(v)
        hot.append(k > 1)
    return np.array(ends), np.append(np.array(hot, bool), False)


def distance_correlation(df: DataFrame, x: str, y: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distance correlation over all rows with both values: (x, y, n, dcor); 0 where a side does not vary, null without rows.

    The cuts of the buckets (as many numbers as buckets) and the totals go through the driver; rows move twice, once by x bucket and once by y bucket.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")).first()
    n, mx, my = size["n"], size["mx"] or 0.0, size["my"] or 0.0
    buckets = max(1, min(MOST_BUCKETS, -(-n // bucket_rows)))
    sides = {c: _cuts(rows, c, buckets) for c in ("x", "y")}

    def placed(batches):
        for batch in batches:
            out = {"x": batch.column("x").to_numpy() - mx, "y": batch.column("y").to_numpy() - my}
            for c in ("x", "y"):
                ends, hot = sides[c]
                at = np.searchsorted(ends, batch.column(c).to_numpy(), "left")
                spread = np.arange(len(at)) % SHARES
                out |= {f"b{c}": at.astype(np.int32), f"s{c}": np.where(hot[at], spread, 0).astype(np.int32) if len(hot) else np.zeros(len(at), np.int32)}
            yield pa.RecordBatch.from_pydict(out)

    cut = rows.mapInArrow(placed, "x double, y double, bx int, sx int, by int, sy int")
    wide = {c: {int(i) for i in np.flatnonzero(sides[c][1])} for c in ("x", "y")}
    sums = F.count(F.lit(1)).cast("double").alias("c"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy")
    cells = cut.groupBy("bx", "by").agg(*sums, F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))

    def before(keys, order):  # sums of all buckets before, by one side
        per = cells.groupBy(keys).agg(F.sum("c").alias("n"), F.sum(order).alias("s"))
        return per.orderBy(keys).collect()  # one row a bucket

    prefix, totals = {}, {}
    for c in ("x", "y"):
        found = before(f"b{c}", c)
        totals[c] = float(sum(r["s"] for r in found))
        at, count, total = {}, 0.0, 0.0
        for r in found:
            at[r[f"b{c}"]] = (count, total)
            count, total = count + r["n"], total + r["s"]
        prefix[c] = at

    def row_sums(values: np.ndarray, side: str, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the values, and in that order the sums of their distances from all rows."""
        order = np.argsort(values, kind="stable")
        v = values[order]
        count, total = prefix[side][bucket]
        alone = bucket in wide[side]
        c = count + (0 if alone else np.arange(len(v)))
        s = total + (0.0 if alone else np.cumsum(v) - v)
        return order, v * (2 * c - n) + totals[side] - 2 * s

    def by_x(key, table):
        bucket = key[0].as_py()
        own = {k: table.column(k).to_numpy() for k in ("x", "y", "by", "sy")}
        order, a = row_sums(own["x"], "x", bucket)
        w = np.zeros(len(order))
        if bucket not in wide["x"]:
            w[0] = pair_sum(own["x"], own["y"])
        return pa.table({"x": own["x"][order], "y": own["y"][order], "bx": np.full(len(order), bucket, np.int32), "by": own["by"][order], "sy": own["sy"][order], "a": a, "w": w})

    def by_y(key, table):
        bucket = key[0].as_py()
        own = {k: table.column(k).to_numpy() for k in ("x", "y", "bx", "a", "w")}
        order, b = row_sums(own["y"], "y", bucket)
        a, w = own["a"][order], float(own["w"].sum())
        if bucket not in wide["y"]:
            w += pair_sum(own["x"], own["y"])
            at = np.argsort(own["bx"], kind="stable")
            for part in np.split(at, np.flatnonzero(np.diff(own["bx"][at])) + 1):
                w -= pair_sum(own["x"][part], own["y"][part])
        return pa.table({k: [float(v)] for k, v in (("w", w), ("a", a.sum()), ("b", b.sum()), ("ab", (a * b).sum()), ("aa", (a * a).sum()), ("bb", (b * b).sum()))})

    halfway = cut.groupBy("bx", "sx").applyInArrow(by_x, "x double, y double, bx int, by int, sy int, a double, w double")
    ended = halfway.groupBy("by", "sy").applyInArrow(by_y, "w double, a double, b double, ab double, aa double, bb double")
    total = ended.agg(*[F.sum(c).alias(c) for c in ("w", "a", "b", "ab", "aa", "bb")])
    # Pairs apart in both: every cell against those with smaller x bucket, by the side on which their y bucket lies.
    up = Window.partitionBy("bx").orderBy("by").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("bx").orderBy("by").rowsBetween(1, Window.unboundedFollowing)
    left = Window.partitionBy("by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    names = ("c", "x", "y", "xy")
    # A full grid of buckets, so that sums to the left exist for every y bucket a cell is compared with.
    last = int(max(len(sides["x"][0]), len(sides["y"][0])))
    every = F.explode(F.sequence(F.lit(0), F.lit(last)))
    grid = cells.select("bx").distinct().select("bx", every.alias("by")).join(cells.select("bx", "by", *names), ["bx", "by"], "left").fillna(0.0)
    lefts = grid.withColumns({f"_l{k}": F.coalesce(F.sum(k).over(left), F.lit(0.0)) for k in names})
    both = lefts.withColumns({f"_{s}{k}": F.coalesce(F.sum(f"_l{k}").over(w), F.lit(0.0)) for s, w in (("u", up), ("d", down)) for k in names})
    product = lambda s: F.col("xy") * F.col(f"_{s}c") - F.col("x") * F.col(f"_{s}y") - F.col("y") * F.col(f"_{s}x") + F.col("c") * F.col(f"_{s}xy")
    apart = both.where("c > 0").agg(F.sum(product("u") - product("d")).alias("apart"))
    squares = cells.agg(F.sum("xx").alias("xx"), F.sum("yy").alias("yy"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    count = F.lit(float(n))
    pairs = 2 * (F.col("w") + F.col("apart"))
    mean = lambda s: s / (count * count)
    cov = mean(pairs) + mean(F.col("a")) * mean(F.col("b")) - 2 * F.col("ab") / (count * count * count)
    var = lambda s, q, o: mean(2 * count * F.col(q) - 2 * F.col(o) * F.col(o)) + mean(F.col(s)) * mean(F.col(s)) - 2 * F.col(s + s) / (count * count * count)
    vx, vy = var("a", "xx", "sx"), var("b", "yy", "sy")
    scale = lambda v, q: v > 1e-12 * F.col(q) / count
    value = F.when(scale(vx, "xx") & scale(vy, "yy"), F.sqrt(F.greatest(F.lit(0.0), cov / F.sqrt(vx * vy)))).otherwise(0.0)
    parts = [total, apart, squares]
    columns = [c for part in parts for c in part.columns]
    padded = [part.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in part.columns else F.lit(0.0).alias(c) for c in columns]) for part in parts]  # one row each
    one = padded[0].unionByName(padded[1]).unionByName(padded[2]).agg(*[F.sum(c).alias(c) for c in columns])
    return one.select(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(n).cast("long").alias("n"), F.when(F.lit(n > 0), value).alias("dcor"))

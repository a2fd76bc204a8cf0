"""Statistics on tiny vectors with known answers."""

import math
import random

import numpy as np
import pytest

from spanframe.functions.pvalues import fisher_two_sided, t_two_sided
from spanframe.operators import claims, correlate, effects, matrix, quality, scan


def aligned(spark, a, b):
    return spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(a, b, strict=True)], "g string, value_a double, value_b double")


def test_t_p_value():
    # Two-sided tail areas of Student's t from standard tables.
    assert t_two_sided(np.array([2.228]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-4)
    assert t_two_sided(np.array([1.0]), np.array([1.0]))[0] == pytest.approx(0.5, abs=1e-9)
    assert t_two_sided(np.array([0.0]), np.array([5.0]))[0] == pytest.approx(1.0)


def test_fisher_tea_tasting():
    assert fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert fisher_two_sided(0, 0, 0, 0) == 1.0


@pytest.mark.parametrize("a,b,r,reason", [
    ([1, 2, 3, 4], [2, 4, 6, 8], 1.0, None), ([1, 2, 3, 4], [4, 3, 2, 1], -1.0, None),
    ([1, 1, 1, 1], [1, 2, 3, 4], None, "zero_variance"), ([1, 2], [1, 2], None, "insufficient_data"),
])
def test_pearson_cases(spark, a, b, r, reason):
    row = correlate.pearson(aligned(spark, a, b), ["g"]).first()
    assert row["reason"] == reason
    assert row["r"] is None if r is None else row["r"] == pytest.approx(r)
    if r is not None:
        assert row["p_value"] < 1e-6


def test_spearman_is_one_for_monotone(spark):
    assert correlate.spearman(aligned(spark, [1, 2, 3, 4, 5], [1, 8, 27, 64, 1000]), ["g"]).first()["r"] == pytest.approx(1.0)


def test_presence_statistics(spark):
    df = aligned(spark, [1, 0, 2, 0], [1, 3, 0, 0])
    assert correlate.jaccard(df, ["g"]).first()["value"] == pytest.approx(1 / 3)
    table = correlate.fisher_exact(df, ["g"]).first()
    assert (table["both"], table["a_only"], table["b_only"], table["neither"], table["value"]) == (1, 1, 1, 1, 1.0)
    disjoint = aligned(spark, [1, 0], [0, 1])
    assert correlate.overlap_enrichment(disjoint, ["g"]).first()["value"] == 0.0


def test_count_only_statistics_refuse_other_modes(spark):
    with pytest.raises(ValueError):
        correlate.correlate(None, None, "jaccard", 1000, modes=("interval", "count"))


def test_ranks_and_quantiles_match_numpy(spark):
    rng = random.Random(3)
    values = [round(rng.gauss(0, 3), 1) for _ in range(300)] + [100.0] * 150 + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    known = sorted(v for v in values if v is not None)
    got = {r["i"]: r["k"] for r in scan.avg_rank(df, "v", "k").collect()}
    for i, v in enumerate(values):
        want = None if v is None else sum(x < v for x in known) + (sum(x == v for x in known) + 1) / 2
        assert got[i] == want
    row = scan.exact_quantiles(df, [], "v", {"a": 0.05, "b": 0.5, "c": 0.93}, buckets=7).first()
    assert [row["a"], row["b"], row["c"]] == pytest.approx(list(np.percentile(known, [5, 50, 93])))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.03]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = [r["q"] for r in effects.benjamini_hochberg(df, "p", "q").orderBy("i").collect()]
    order = sorted(range(6), key=lambda i: p[i])
    want, low = [0.0] * 6, 1.0
    for rank in range(6, 0, -1):
        i = order[rank - 1]
        low = min(low, p[i] * 6 / rank)
        want[i] = low
    assert got == pytest.approx(want)


def test_distance_correlation_of_a_line_is_one(spark):
    df = spark.createDataFrame([(i, float(i), float(3 * i + 1)) for i in range(40)], "k int, x double, y double")
    row = matrix.distance_correlation(df, "x", "y", "k", 100).first()
    assert row["n_pairs"] == 1600 and row["dcor"] == pytest.approx(1.0)


def test_pca_explains_everything_of_a_line(spark):
    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(20)], "x double, y double")
    assert matrix.pca(df, ["x", "y"], 1).first()["explained"] == pytest.approx(1.0)


def test_claims_three_valued_logic(spark):
    stats = spark.createDataFrame([("a", 2.0), ("b", -1.0)], "stat_id string, value double")
    cols = "claim_id int, node_id string, lhs string, lhs_transform string, op string, rhs string, rhs_transform string, rhs_value double"
    leaves = spark.createDataFrame([
        (1, "x", "a", None, ">", None, None, 1.0), (1, "y", "missing", None, ">", None, None, 0.0),
        (2, "x", "b", "abs", "=", None, None, 1.0), (2, "y", "b", "log", "<", None, None, 0.0),
        (3, "x", "a", None, "<", "b", None, None), (3, "y", "missing", None, "<", None, None, 0.0),
    ], cols)
    nodes = []
    for claim, kind in ((1, "and"), (2, "or"), (3, "and")):
        nodes += [(claim, "r", None, kind, 0), (claim, "x", "r", "cmp", 1), (claim, "y", "r", "cmp", 1)]
    tree = spark.createDataFrame(nodes, "claim_id int, node_id string, parent_id string, kind string, level int")
    got = {r["claim_id"]: r["verdict"] for r in claims.evaluate_claims(tree, leaves, stats, 1).collect()}
    assert got == {1: "PENDING", 2: "LICENSED", 3: "REJECTED"}


def test_content_hash_ignores_order_but_not_copies(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    first = quality.content_hash(df).first()["content_hash"]
    assert quality.content_hash(df.repartition(7).orderBy("b")).first()["content_hash"] == first
    assert quality.content_hash(df.union(df.limit(1))).first()["content_hash"] != first


def test_row_guards(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        quality.assert_base_rows(df, 5)
    with pytest.raises(ValueError):
        quality.assert_updated(df, spark.range(10, 12), ["id"])


def test_cosine_does_not_depend_on_slots(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(4)], [False, False, rng.random() < 0.3, False]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, vector array<double>, mask array<boolean>")
    ask = df.where("id < 5").select("id")
    a, b = (sorted((r["query_id"], r["id"], round(r["similarity"], 9)) for r in
            effects.cosine_similar(df, ask, "id", 3, slots=n).collect()) for n in (1, 4))
    assert a == b and len(a) == 15
    for q in range(5):
        scores = []
        for i, v, m in rows:
            both = [(x, y) for x, y, p, o in zip(v, rows[q][1], m, rows[q][2]) if not p and not o]
            norm = math.sqrt(sum(x * x for x, _ in both)) * math.sqrt(sum(y * y for _, y in both))
            scores.append((-sum(x * y for x, y in both) / norm, i))
        best = sorted(s for s in scores if s[1] != q)[:3]
        assert [x[1] for x in sorted((x for x in a if x[0] == q), key=lambda x: (-x[2], x[1]))] == [i for _, i in best]
    assert all(math.isfinite(x[2]) for x in a)


def test_rank_buckets_follow_the_values_not_their_range(spark):
    from pyspark.sql import functions as F

    from spanframe.operators import scan

    values = [i / 1e6 for i in range(4000)] + [10.0 * i for i in range(1, 5)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ranks = scan.value_ranks(df, [], "v", buckets=16)
    assert {r["v"]: r["n_before"] for r in ranks.collect()} == {v: i for i, v in enumerate(sorted(values))}
    cuts = df.agg(F.percentile_approx("v", [i / 16 for i in range(1, 16)], F.lit(320))).first()[0]
    sizes = [sum(sum(c < v for c in cuts) == b for v in values) for b in range(16)]
    assert max(sizes) <= 2 * len(values) / 16
    assert scan.avg_rank(df, "v", "r").where("v is null and r is null").count() == 1


def test_fisher_many_tables_equal_exact_fractions():
    from fractions import Fraction

    from spanframe.functions.pvalues import fisher_two_sided_many

    rng = np.random.default_rng(2)
    tables = np.vstack([rng.integers(0, 12, (600, 4)), rng.integers(0, 300, (120, 4)), [[0, 0, 0, 0], [5, 0, 0, 5], [1, 0, 0, 0], [10] * 4, [100] * 4, [7, 3, 3, 7], [0, 9, 0, 3]]])
    for row, got in zip(tables.tolist(), fisher_two_sided_many(*tables.T)):
        a, b, c, d = row
        weights = [math.comb(a + b, k) * math.comb(c + d, a + c - k) for k in range(max(0, a - d), min(a + b, a + c) + 1)]
        seen = math.comb(a + b, a) * math.comb(c + d, c)
        assert got == pytest.approx(float(Fraction(sum(w for w in weights if w <= seen), sum(weights))), rel=1e-9), row


def test_fisher_of_large_tables_does_not_walk_their_support():
    from spanframe.functions.pvalues import fisher_two_sided_many

    rng = np.random.default_rng(3)
    row, column = rng.integers(1, 10**9, (2, 2000))
    both = row * column // (2 * 10**9) + rng.integers(0, 3000, 2000)
    p = fisher_two_sided_many(both, row - both, column - both, 2 * 10**9 - row - column + both)
    assert ((p >= 0) & (p <= 1)).all() and len(np.unique(p)) > 500
    assert fisher_two_sided(250_000, 250_000, 250_000, 250_000) == 1.0


def test_rank_buckets_follow_the_number_of_values(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(g, rng.choice([rng.gauss(0, 1), float(rng.randrange(5))])) for g in "aab" for _ in range(3000)] + [("c", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g in "abc":
        own = sorted(v for k, v in rows if k == g and v is not None)
        for v in set(own):
            want[g, v] = (own.count(v), sum(x < v for x in own) if len(own) < 10 else np.searchsorted(own, v), len(own))
    for per_bucket in (4096, 300, 10):
        monkeypatch.setattr(scan, "BUCKET_VALUES", per_bucket)
        got = scan.value_ranks(df, ["g"], "v").collect()
        assert {(r["g"], r["v"]): (r["n_at"], r["n_before"], r["n_total"]) for r in got} == want


def test_spearman_matrix_is_one_pass(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 9, (80, 4)).astype(float)
    values[:, 3] = values[:, 0] ** 3 + rng.normal(size=80) / 10
    rows = [(i, *[None if (i + j) % 9 == 0 else float(v) for j, v in enumerate(row)]) for i, row in enumerate(values)] + [(99, None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double")
    out = matrix.spearman_matrix(df, ["a", "b", "c", "d"], "k")
    ranks = np.full((81, 4), np.nan)
    for j in range(4):
        own = np.array([np.nan if r[j + 1] is None else r[j + 1] for r in rows])
        for i in np.flatnonzero(~np.isnan(own)):
            ranks[i, j] = (own < own[i]).sum() + ((own == own[i]).sum() + 1) / 2
        ranks[np.isnan(ranks[:, j]), j] = np.nanmean(ranks[:, j])
    want = np.corrcoef(ranks.T)
    for r in out.collect():
        assert r["n"] == 81 and r["r"] == pytest.approx(want["abcd".index(r["x"]), "abcd".index(r["y"])], abs=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [line for line in plan.split("\n") if "Exchange " in line and "ReusedExchange" not in line]
    assert len(made) < 20, len(made)

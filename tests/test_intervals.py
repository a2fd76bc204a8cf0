"""Interval operators on small frames, against brute force and the known edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from spanframe.functions import coords
from spanframe.operators import lift, merge, nearest, overlap, region, topk, windows
from spanframe.operators.overlap import KEYS

SCHEMA = "build string, chr_id int, start_pos long, end_pos long, id int"


def frame(spark, rows):
    return spark.createDataFrame([("b", c, s, e, i) for i, (c, s, e) in enumerate(rows)], SCHEMA)


def random_rows(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        start = rng.randrange(0, 3000)
        out.append((rng.randrange(1, 3), start, start + rng.choice([1, 5, 40, longest])))
    return out + out[:10]  # exact copies too


@pytest.mark.parametrize("levels", [None, [64], [64, 1024], [32, 256, 2048]])
def test_overlap_join_equals_brute_force(spark, levels):
    a, b = random_rows(1, 120, 2500), random_rows(2, 90, 900)
    got = sorted(
        (r["id"], r["b_id"]) for r in overlap.overlap_join(frame(spark, a), frame(spark, b), levels=levels).select("id", "b_id").collect()
    )
    want = sorted(
        (i, j) for i, (c, s, e) in enumerate(a) for j, (d, t, f) in enumerate(b) if c == d and s < f and t < e
    )
    assert got == want


def test_touching_intervals_do_not_overlap(spark):
    a, b = frame(spark, [(1, 0, 10)]), frame(spark, [(1, 10, 20), (1, 9, 10)])
    assert [r["b_id"] for r in overlap.overlap_join(a, b).collect()] == [1]


def test_count_overlaps_equals_pairs(spark):
    a, b = random_rows(3, 60, 700), random_rows(4, 80, 1500)
    got = {r["id"]: r["n_overlaps"] for r in overlap.count_overlaps(frame(spark, a), frame(spark, b), chunk=100).collect()}
    want = {i: sum(c == d and s < f and t < e for d, t, f in b) for i, (c, s, e) in enumerate(a)}
    assert got == want


@pytest.mark.parametrize("gap", [0, 7])
@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_merge_intervals(spark, gap, chunk):
    rows = random_rows(5, 150, 60)
    got = sorted((r["chr_id"], r["start_pos"], r["end_pos"], r["n_merged"]) for r in
                 merge.merge_intervals(frame(spark, rows), gap, chunk=chunk).collect())
    want = []
    for chrom in (1, 2):
        for c, s, e in sorted(r for r in rows if r[0] == chrom):
            if want and want[-1][0] == c and s - want[-1][2] <= gap:
                last = want[-1]
                want[-1] = (c, last[1], max(last[2], e), last[3] + 1)
            else:
                want.append((c, s, e, 1))
    assert got == sorted(want)


def test_nearest_distance_brute_force(spark):
    feats = random_rows(6, 12, 300)
    pts = [(1 + i % 2, p) for i, p in enumerate(range(0, 3500, 37))]
    points = spark.createDataFrame([("b", c, p) for c, p in pts], "build string, chr_id int, pos long")
    got = {(r["chr_id"], r["pos"]): r["distance"] for r in nearest.nearest_distance(points, frame(spark, feats), chunk=64).collect()}
    for c, p in pts:
        want = min(0 if s <= p <= e else min(abs(p - s), abs(p - e)) for d, s, e in feats if d == c)
        assert got[(c, p)] == want


@pytest.mark.parametrize("pos,context", [
    (9999, "n_shore"), (10000, "island"), (10999, "island"), (11000, "s_shore"), (8000, "n_shore"), (7999, "n_shelf"), (6000, "n_shelf"),
    (5999, "open_sea"), (12999, "s_shore"), (13000, "s_shelf"), (14999, "s_shelf"), (15000, "open_sea"),
])
def test_site_context_boundaries(spark, pos, context):
    sites = spark.createDataFrame([("b", 1, pos, 0)], "build string, chr_id int, pos long, id int")
    assert nearest.classify_sites(sites, frame(spark, [(1, 10000, 11000)]), ["id"]).first()["context"] == context


def test_region_text(spark):
    df = spark.createDataFrame([("chr1:1-10",), ("chrX:5-5",), ("chr1:10-1",), ("chr99:1-2",), ("1:1-2",), (None,)], "region string")
    rows = {r["region"]: r for r in coords.parse_regions(df).collect()}
    assert (rows["chr1:1-10"]["start_pos"], rows["chr1:1-10"]["end_pos"], rows["chr1:1-10"]["reject"]) == (0, 10, None)
    assert rows["chrX:5-5"]["chr_id"] == 23
    assert [rows[k]["reject"] for k in ("chr1:10-1", "chr99:1-2", "1:1-2", None)] == ["order", "chromosome", "format", "format"]


def test_window_coverage_counts_twice_before_cap(spark):
    layer = frame(spark, [(1, 0, 600), (1, 100, 700), (1, 1000, 1100)])
    base = spark.createDataFrame([("b", 1, 0), ("b", 1, 1000), ("b", 1, 2000)], "build string, chr_id int, start_pos long")
    out = windows.coverage_fraction(base, layer, {"f": F.lit(True)})
    assert {r["start_pos"]: r["f"] for r in out.collect()} == {0: 1.0, 1000: 0.1, 2000: 0.0}


def test_rolling_mean_is_independent_of_chunks(spark):
    df = spark.createDataFrame([("k", i, float(i * i % 17) if i % 5 else None) for i in range(100)], "k string, i long, v double")
    a, b = (sorted((r["i"], round(r["m"], 9)) for r in windows.rolling_mean(df, ["k"], "i", "v", "m", 6, chunk=c).collect())
            for c in (4096, 10))
    assert a == b


def test_intersect_modes(spark):
    a, b = frame(spark, [(1, 0, 10), (1, 5, 9)]), frame(spark, [(1, 0, 10), (1, 0, 10), (1, 20, 30)])
    assert [tuple(r)[2:] for r in region.intersect_layers([a, b]).collect()] == [(0, 10)]
    assert region.intersect_layers([a, b], "overlap").count() == 2
    with pytest.raises(ValueError):
        region.intersect_layers([])


def test_lift_shifts_and_reports_unmapped(spark):
    blocks = spark.createDataFrame([("b", 1, 0, 100, 2, 1000)], "build string, chr_id int, start_pos long, end_pos long, dst_chr_id int, offset long")
    mapped, lost = lift.lift_intervals(frame(spark, [(1, 10, 20), (1, 95, 105)]), blocks, ["id"])
    assert [(r["id"], r["chr_id"], r["start_pos"]) for r in mapped.collect()] == [(0, 2, 1010)]
    assert [r["id"] for r in lost.collect()] == [1]


def test_method_priority_order(spark):
    df = spark.createDataFrame([("k", "liftover", 1), ("k", "exact_id", 2), ("k", "coord_overlap", 0)], "k string, method string, id int")
    assert topk.dedup_by_priority(df, ["k"]).first()["method"] == "exact_id"


def test_field_predicate_rejects_unknown_names():
    with pytest.raises(ValueError):
        coords.field_predicate("x", ">", 1, ("y",))
    with pytest.raises(ValueError):
        coords.field_predicate("y", "~", 1, ("y",))


def test_join_plans_have_no_nested_loops(spark):
    a, b = frame(spark, random_rows(7, 30, 50)), frame(spark, random_rows(8, 30, 50))
    for df in (overlap.overlap_join(a, b), overlap.count_overlaps(a, b), merge.merge_intervals(a),
               nearest.nearest_distance(a.withColumn("pos", F.col("start_pos")).select(*KEYS, "pos"), b)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_pages_meet_every_row_once(spark):
    from spanframe.operators.topk import page_after

    df = spark.createDataFrame([(i // 7, i) for i in range(100)], "pos int, id int")
    seen, cursor = [], None
    while page := page_after(df, cursor, 9).collect():
        seen += [(r["pos"], r["id"]) for r in page]
        cursor = seen[-1]
    assert seen == [(i // 7, i) for i in range(100)]


def test_region_query_is_complete_unless_paged(spark):
    from spanframe.operators import region

    layer = spark.createDataFrame([("b", 1, i, i + 5) for i in range(50)], "build string, chr_id int, start_pos int, end_pos int")
    regions = spark.createDataFrame([(1, "b", 1, 0, 100)], "region_id int, build string, chr_id int, start_pos int, end_pos int")
    assert region.region_query(layer, regions).count() == 50
    page = region.region_query(layer, regions, 10).collect()
    assert len(page) == 10 and {r["status"] for r in page} == {"truncated"}


@pytest.mark.parametrize("order", ["distance", "symbol"])
def test_nearest_within_brute_force(spark, order):
    rng = random.Random(21)
    feats = [(1, s, s + rng.choice([1, 3, 20, 400]), rng.choice(["a", "b", "c", "d"]) + str(rng.randrange(3))) for s in (rng.randrange(0, 6000) for _ in range(60))]
    feats += [(1, 100, 5900, "long"), (1, 100, 5800, "alike"), (2, 10, 12, "z"), feats[0]]
    asks = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(0, 6100)) for i in range(150)] + [(1000, 1, 100), (1001, 1, 100)]
    frame_f = spark.createDataFrame([("b", *f) for f in feats], "build string, chr_id int, start_pos long, end_pos long, symbol string")
    frame_p = spark.createDataFrame([(i, "b", c, p) for i, c, p in asks], "id long, build string, chr_id int, pos long")
    for radius in (5, 60, 700):
        want = {}
        for i, c, p in asks:
            near = [(abs(s - p), s, e, n) for k, s, e, n in feats if k == c and s < p + radius and e > p - radius]
            best = min(near, key=lambda x: (x[3], *x) if order == "symbol" else x, default=None)
            want[i] = best
        got = nearest.nearest_within(frame_p, frame_f, ["id"], radius, order=order, symbol="symbol", chunk=256)
        assert got.columns == ["id", "build", "chr_id", "pos", "b_start_pos", "b_end_pos", "b_symbol", "distance"]
        assert {r["id"]: None if r["distance"] is None else (r["distance"], r["b_start_pos"], r["b_end_pos"], r["b_symbol"]) for r in got.collect()} == want
        assert got.count() == len(asks)


def test_any_number_of_layers_intersect(spark):
    layers = [frame(spark, [(1, 0, 10), (1, 20, 30), (1, 20, 30), *([(1, 5, 6)] if i % 70 else [])]) for i in range(130)]
    assert sorted(tuple(r)[2:] for r in region.intersect_layers(layers[:11]).collect()) == [(0, 10), (20, 30)]
    assert sorted(tuple(r)[2:] for r in region.intersect_layers(layers).collect()) == [(0, 10), (20, 30)]
    assert sorted(tuple(r)[2:] for r in region.intersect_layers(layers[1:70]).collect()) == [(0, 10), (5, 6), (20, 30)]


def test_overlap_join_runs_no_job_while_it_is_planned(spark):
    a, b = frame(spark, random_rows(3, 30, 2000)), frame(spark, random_rows(4, 30, 70_000))
    spark.sparkContext.setJobGroup("planning", "overlap join")
    pairs = overlap.overlap_join(a, b)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    assert pairs.count() > 0
    assert overlap.overlap_join(a, b.where("id < 0")).count() == 0
    points = a.withColumn("end_pos", F.col("start_pos") + 1)
    assert overlap.overlap_join(points, b, length=1).count() == overlap.overlap_join(points, b).count() > 0

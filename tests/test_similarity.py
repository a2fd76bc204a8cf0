"""Masked cosine over layers against a plain double loop."""

import math
import random

import numpy as np
import pytest

from spanframe.operators import similarity

SIZES = {"one": 3, "two": 5}


def plain(q, v, places):
    both = [(x, y) for i in places for x, y in [(q[0][i], v[0][i])] if not q[1][i] and not v[1][i] and x is not None and y is not None and not math.isnan(x) and not math.isnan(y)]
    norm = math.sqrt(sum(x * x for x, _ in both)) * math.sqrt(sum(y * y for _, y in both))
    return (sum(x * y for x, y in both) / norm if norm > 0 else None), len(both)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    cell = lambda: rng.choice([None, float("nan"), 0.0, *[rng.uniform(-2, 2) for _ in range(12)]])
    own = {f"g{i:02}": ([cell() for _ in range(8)], [rng.random() < 0.2 for _ in range(8)]) for i in range(40)}
    own["g40"], own["g41"] = own["g03"], own["g03"]  # ties
    own["g42"] = ([0.0] * 8, [False] * 8)
    own["g43"] = ([1.0] * 8, [True] * 8)
    return own


@pytest.mark.parametrize("mode", ["integrated", "one", "two"])
@pytest.mark.parametrize("parts", [1, 5])
def test_modes(spark, rows, mode, parts, monkeypatch):
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "id string, vector array<double>, mask array<boolean>")
    layers = {"one": (0, 3), "two": (3, 8)}
    got = similarity.most_similar(df, df.select("id").union(df.select("id")), "id", 4, layers, mode, digits=6, parts=parts).collect()
    places = range(8) if mode == "integrated" else range(*layers[mode])
    want = []
    for q in rows:
        scored = []
        for v in rows:
            s, n = plain(rows[q], rows[v], places)
            if v != q and s is not None and n >= 0.5 * len(places):
                scored.append((-round(s, 6), v, n))
        want += [(q, v, n, i + 1) for i, (s, v, n) in enumerate(sorted(scored)[:4])]
    assert sorted((r["query_id"], r["id"], r["n_shared"], r["rank"]) for r in got) == sorted(want)
    for r in got:
        assert r["similarity"] == pytest.approx(plain(rows[r["query_id"]], rows[r["id"]], places)[0], abs=1e-9)
        assert r["coverage"] == pytest.approx(r["n_shared"] / len(places))
        for name, (a, b) in layers.items():
            own = plain(rows[r["query_id"]], rows[r["id"]], range(a, b))[0] if mode in ("integrated", name) else None
            assert r[f"sim_{name}"] == (None if own is None else pytest.approx(own, abs=1e-9))


def test_blocks_of_queries_and_batches_of_rows(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(6)], [False] * 6) for i in range(1200)], "id long, vector array<double>, mask array<boolean>")
    ask = df.where("id < 700").select("id")  # two blocks of queries
    a = similarity.most_similar(df, ask, "id", 3).collect()
    assert len(a) == 2100
    vectors = {r["id"]: r["vector"] for r in df.collect()}
    for q in (0, 350, 699):
        best = sorted((-round(plain((vectors[q], [False] * 6), (vectors[v], [False] * 6), range(6))[0], 10), v) for v in vectors if v != q)[:3]
        assert [r["id"] for r in sorted(a, key=lambda r: r["rank"]) if r["query_id"] == q] == [v for _, v in best]


def test_joined_layers(spark):
    long = spark.createDataFrame([("a", "two", [1.0, 2.0], [False, True]), ("b", "one", [3.0], [False]), ("b", "two", [4.0, None], [False, False])], "id string, layer string, z array<double>, missing array<boolean>")
    wide, slices = similarity.join_layers(long, "id", {"one": 1, "two": 2})
    assert slices == {"one": (0, 1), "two": (1, 3)}
    assert sorted(map(tuple, wide.collect())) == [("a", [0.0, 1.0, 2.0], [True, False, True]), ("b", [3.0, 4.0, None], [False, False, False])]


def test_nothing_to_compare(spark):
    empty = spark.createDataFrame([], "id string, vector array<double>, mask array<boolean>")
    assert similarity.most_similar(empty, empty, "id", 3).count() == 0
    with pytest.raises(ValueError):
        similarity.most_similar(empty, empty, "id", 3, {"one": (0, 3)}, "other")


def test_rows_are_shuffled_once_and_not_once_a_block(spark, monkeypatch):
    """Before, every row was dealt to every block of queries, so shuffled rows grew with the pairs."""
    monkeypatch.setattr(similarity, "FEW_QUERIES", 16)
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 5)], [False, i % 3 == 0, False]) for i in range(400)], "id long, vector array<double>, mask array<boolean>")
    plan = similarity.most_similar(df, df.select("id"), "id", 3, parts=2)._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


def odd_rows(masks):
    rng = random.Random(masks)
    kinds = [[rng.random() < 0.3 for _ in range(8)] for _ in range(masks)]
    own = {}
    for i in range(300):
        scale = rng.choice([1.0, 1e-9, 1e12])
        own[i] = ([rng.choice([0.0, rng.uniform(-1, 1)]) * scale for _ in range(8)], rng.choice(kinds))
    for i in range(0, 300, 9):
        own[i] = own[0]
    return own


@pytest.mark.parametrize("together", [1, 1000])
@pytest.mark.parametrize("masks", [3, 1000])
def test_screened_rows(monkeypatch, masks, together):
    """Common masks are screened together and rare ones alone; ties, copies, zeros and far apart scales come out as in a double loop."""
    for name, value in {"FIRST": 8, "SHARED": 4, "TOGETHER": together, "SCALED": 2, "TILE": 256, "EXACT": 128}.items():
        monkeypatch.setattr(similarity, name, value)
    own = odd_rows(masks)
    side = lambda ids: similarity._Side(np.array([own[i][0] for i in ids]) * ~np.array([own[i][1] for i in ids]), ~np.array([own[i][1] for i in ids]), ids)
    best = similarity._Best(side(list(own)), 4, {"one": slice(0, 3), "two": slice(3, 8)}, ["one", "two"], 0.5, 4)
    for start in range(0, 300, 48):
        best.meet(side(list(own)[start : start + 48]), start)
    for q in own:
        scored = sorted((-round(s, 4), v) for v in own if v != q for s, n in [plain(own[q], own[v], range(8))] if s is not None and n >= 4)
        assert [x for x in best.ids[q].tolist() if x is not None] == [v for _, v in scored[:4]]


@pytest.mark.parametrize("masks", [3, 1000])
def test_modes_together_in_many_blocks_and_batches(spark, monkeypatch, masks):
    for name, value in {"FEW_QUERIES": 40, "QUERIES": 64, "ROWS": 48}.items():
        monkeypatch.setattr(similarity, name, value)
    own = odd_rows(masks)
    df = spark.createDataFrame([(k, *v) for k, v in own.items()], "id long, vector array<double>, mask array<boolean>")
    layers = {"one": (0, 3), "two": (3, 8)}
    got = similarity.most_similar_by_mode(df, df.select("id"), "id", 4, layers, ["one", "integrated", "two"], digits=4, parts=2).collect()
    places = {"integrated": range(8), "one": range(3), "two": range(3, 8)}
    want = []
    for mode, here in places.items():
        for q in own:
            scored = sorted((-round(s, 4), v) for v in own if v != q for s, n in [plain(own[q], own[v], here)] if s is not None and n >= 0.5 * len(here))
            want += [(mode, q, v, i + 1) for i, (_, v) in enumerate(scored[:4])]
    assert sorted((r["mode"], r["query_id"], r["id"], r["rank"]) for r in got) == sorted(want)

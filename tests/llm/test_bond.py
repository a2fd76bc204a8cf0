"""Operator 11 against brute force: other labels, windows, ties, odd rows, block borders."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.llm import bond, queries
from tests.llm.tables import write_tables


def plain(rows, every=50, positives=5, negatives=3):
    own = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        own.append((vec_id, [max(-bond.LIMIT, min(bond.LIMIT, math.floor(256 * x))) for x in vector], label))
    out = []
    for a, v, label in own:
        if a % every:
            continue
        others = [(-sum(x * y for x, y in zip(v, w)), i, k) for i, w, k in own if i != a and len(w) == len(v)]
        near = sorted(x for x in others if x[2] == label)[:positives]
        far = sorted(x for x in others if x[2] != label)
        for p, i, _ in near:
            inside = [(j, -n) for n, j, _ in far if 50 * -p <= 100 * -n <= 95 * -p][:negatives]
            out += [(a, i, r + 1, j, -p, n) for r, (j, n) in enumerate(inside)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_equals_brute_force(spark, tmp_path):
    path = write_tables(spark, str(tmp_path))
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = plain(rows)
    assert len(want) > 20 and any(a == 550 for a, *_ in want) and any(a == 600 for a, *_ in want)
    assert got(queries.op11_hard_negatives(spark, path)) == want


@pytest.mark.parametrize("kind", ["copies", "spread"])
def test_small_blocks(spark, monkeypatch, kind):
    rng = random.Random(4)
    base = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(6)]
    vector = (lambda: rng.choice(base)) if kind == "copies" else (lambda: [rng.gauss(0, 0.3) for _ in range(12)])
    rows = [(i, vector(), rng.randrange(2)) for i in range(700)]
    monkeypatch.setattr(bond, "FEWEST", 100)
    monkeypatch.setattr(bond, "COMPONENTS", 12 * 30)
    monkeypatch.setattr(bond, "ANCHORS", 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert got(bond.hard_negatives(df, label, every=10)) == plain(rows, every=10)


def test_kernel_keeps_every_row_that_bounds_cannot_rule_out():
    rng = np.random.default_rng(1)
    for kind in (np.float32, np.float64, np.int64):
        values = rng.integers(-90, 90, (400, 16)).astype(kind)
        block = bond.Block(np.arange(400), rng.integers(0, 3, 400), values)
        seen = []
        for q in values[:20]:
            rows, scores = bond.vertical(block, q, 25_000, lambda low, high, rows: seen.append(np.count_nonzero(high >= 25_000)) or high >= 25_000)
            exact = values @ q
            assert set(np.flatnonzero(exact >= 25_000)) <= set(rows) and np.array_equal(scores, exact[rows])
        assert seen and min(seen) < 100


def test_number_types():
    assert bond.exact_type(np.full((1, 64), 150), np.full((1, 64), 150)) is np.float32
    assert bond.exact_type(np.full((1, 64), 1 << 20), np.full((1, 64), 1 << 20)) is np.float64
    assert bond.exact_type(np.full((1, 64), bond.LIMIT), np.full((1, 64), bond.LIMIT)) is np.int64

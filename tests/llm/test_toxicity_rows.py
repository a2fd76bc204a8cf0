"""Operator 10 learns from every labelled row: none is left out by a sample, of training, calibration or thresholds."""

import numpy as np

from spanframe.llm import langid, toxicity


def test_every_labelled_row_trains_or_calibrates(spark, monkeypatch):
    n = 9000
    docs = spark.range(n).selectExpr("id as doc_id", "concat(if(id % 20 = 0, 'vile dreadful ', 'mild pleasant '), 'w', id % 97) as text", "'en' as lang").coalesce(2)
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 20 = 0 as int) as toxic")
    codes = langid.Codes([], np.zeros((0, 0), bool), np.zeros((0, 0)), None)
    seen, own = [], toxicity.best_threshold
    monkeypatch.setattr(toxicity, "best_threshold", lambda p, y, w: seen.append((w[y == 0].sum(), w[y == 1].sum())) or own(p, y, w))
    trained, start = [], toxicity.begin
    monkeypatch.setattr(toxicity, "begin", lambda words, n0, n1: trained.append((n0, n1)) or start(words, n0, n1))
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 2000)
    net = toxicity.learn(docs, labels, codes, 1, 1)
    assert [a + b for a, b in zip(seen[0], trained[0])] == [n - n // 20, n // 20]
    got = {(r["doc_id"] % 20 == 0, r["score"] >= 0.5) for r in toxicity.score(docs, net, codes, "doc_id").collect()}
    assert got == {(True, True), (False, False)}


def test_sums_of_slices(spark):
    net = toxicity.begin(np.ones((2, toxicity.PAD + 1)), 3, 2)
    flat = toxicity._flat(net)
    parts = spark.range(0, 4, 1, 4).mapInArrow(lambda batches: (toxicity._slices(flat * 0.25) for _ in batches), toxicity.SPARSE)
    again = toxicity._unflat(toxicity._summed(parts, len(flat)))
    assert (again.embedding == net.embedding).all() and all((a == b).all() for a, b in zip(again.filters, net.filters)) and (again.output == net.output).all()

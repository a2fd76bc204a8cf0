"""Stages of the pipeline over planted rows."""

import random

import corpus_pipeline


def test_near_copies_with_one_word_in_fifty_changed(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(50)]
    copy, apart = base[:25] + ["changed"] + base[26:], base[:12] + ["one"] + base[13:37] + ["two"] + base[38:]
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(apart)), (None, " ".join(base))]
    kept = corpus_pipeline.keep_distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    # One word changes 5 of 46 shingles of five words (41 of 51 in common, 0.804), two words 10 of them.
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 3, None]

"""Rules of flags over pieces that are cut once, and counts of steps in the kernel."""

import random

import pytest
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.seqexpr import clean, with_step_counts
from spanframe.operators.sequence import flags, kernel, motifs


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    word = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    rows = []
    for i, n in enumerate((0, 5, 9, 10, 99, 101, 8191, 8192, 8193, 8206, 8292, 8393, 16400, 20000)):
        text = word(n)
        if n > 8000:  # repeats that lie in different chunks, islands and runs across a seam
            text = text[:50] + text[-60:-20] + text[90:8100] + "CG" * 60 + "A" * 30 + "TG" * 40 + text[8330:]
            text = text[: n - 40] + word(20) + text[50:70]
        rows.append((i, text))
    rows += [(20, "ACGTN" * 2000 + "NN" + word(9000)), (21, None), (22, "ACGTRYX" * 30), (23, "acgt acgt" * 40), (24, word(300)), (24, word(9000, "ACGTN")), (None, word(400))]
    return spark.createDataFrame(rows, "seq_id long, sequence string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rules_over_pieces_are_those_over_sequences(texts):
    good = flags.validate(texts).where("reject IS NULL").select("seq_id", "sequence")
    pieces = flags.flag_pieces(good)
    assert rows(motifs.kmer_repeats(good, pieces=pieces)) == rows(motifs.kmer_repeats(good))
    assert rows(motifs.gc_windows(good, 100, pieces)) == rows(motifs.gc_windows(good, 100))
    assert rows(motifs.homopolymers(good, pieces=pieces)) == rows(motifs.homopolymers(good))
    assert rows(motifs.dinuc_repeats(good, pieces=pieces)) == rows(motifs.dinuc_repeats(good))
    assert rows(motifs.island_spans(good, pieces=pieces)) == rows(motifs.island_spans(good))
    assert rows(flags.stability_windows(good, 100, pieces)) == rows(flags.stability_windows(good, 100))


def test_step_counts(spark, texts):
    good = flags.validate(texts).where("reject IS NULL AND sequence IS NOT NULL").select("seq_id", "sequence")
    names = [f"c_{d}" for d in K.DINUCLEOTIDES]
    want = with_step_counts(good.withColumn("sequence", clean(F.col("sequence")))).select("seq_id", *names)
    got = kernel.step_counts(good, "sequence", names)
    assert rows(got.select("seq_id", *names)) == rows(want)
    long = spark.createDataFrame([(1, "ACGTNNACG" * 30000 + "NA")], "seq_id long, sequence string")  # more than a block
    want = with_step_counts(long.withColumn("sequence", clean(F.col("sequence")))).select(*names)
    assert rows(kernel.step_counts(long, "sequence", names).select(*names)) == rows(want)


@pytest.mark.parametrize("operator", [flags.evaluate, flags.flags])
def test_sequences_are_read_once(spark, operator):
    """Before, every rule read and normalised the sequences anew."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i, "ACGT" * 20 + "A" * 12) for i in range(20)], "seq_id long, sequence string").mapInArrow(count, "seq_id long, sequence string")
    assert operator(df).count() > 0
    assert seen.value == 20

"""Sequences without steps, k-mers by buckets, windows and stems from chunk kernels."""

import random

import pytest

from spanframe.operators.sequence import constructs, flags, kernel, motifs, thermo

ODD = [(1, ""), (2, "A"), (3, None), (4, "N"), (5, "N" * 13), (6, "ACGTACGTTTGCAACGT")]


def odd(spark):
    return spark.createDataFrame(ODD, "seq_id long, sequence string")


def test_melting_curve_of_sequences_without_steps(spark):
    got = {r.seq_id: r for r in thermo.melting_curve(odd(spark)).collect()}
    assert len(got) == len(ODD)
    assert all(got[i].bubble_propensity == 0 and got[i].melting_width == 120 for i in range(1, 6))
    assert got[6].bubble_propensity > 0


def test_flags_of_sequences_without_steps(spark):
    assert {r.seq_id for r in flags.flags(odd(spark)).collect()} <= {2, 4, 5, 6}
    assert flags.evaluate(odd(spark)).count() == len(ODD)


def text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choices("ACGT", k=n))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("bases", [1 << 22, 500])
def test_shared_kmers_in_buckets(spark, monkeypatch, bases):
    monkeypatch.setattr(kernel, "BUCKET_BASES", bases)
    common, k = text(1, 40), 13
    parts = [(0, 0, text(2, 900) + common), (0, 1, common + text(3, 10000)), (0, 2, "ACGT" * 20), (0, 3, "N" + common[:20]), (1, 0, common), (None, 0, common), (None, 1, common)]
    df = spark.createDataFrame([(*p, False) for p in parts], "construct_id long, part_no long, sequence string, circular boolean")
    want = set()
    first = {}
    for c, p, s in parts:
        for i in range(len(s) - k, -1, -1):
            if "N" not in s[i : i + k]:
                first[c, s[i : i + k], p] = i + 1
    for c, m, p in first:
        if c is not None:
            want |= {(c, m, p, first[c, m, p], q, first[c, m, q]) for q in range(p + 1, 4) if (c, m, q) in first}
    got = constructs.shared_kmers(df).select("construct_id", "kmer", "part_a", "position_a", "part_b", "position_b")
    assert rows(got) == sorted(want)
    assert want


def test_kmer_repeats_in_buckets(spark, monkeypatch):
    unit = text(5, 60)
    flipped = unit[::-1].translate(str.maketrans("ACGT", "TGCA"))
    data = [(1, text(6, 9000) + unit + text(7, 9000) + unit + flipped), (2, unit + "N" + flipped), (None, unit + unit)]
    df = spark.createDataFrame(data, "seq_id long, sequence string")
    want = rows(motifs.kmer_repeats(df))
    monkeypatch.setattr(kernel, "BUCKET_BASES", 700)
    assert rows(motifs.kmer_repeats(df)) == want
    assert {r[0] for r in want} == {1, 2}
    assert {r[1] for r in want} == {"direct", "inverted"}


def test_windows_and_stems_across_chunks(spark):
    s = text(8, 500) + "GAAAAACCTTTTTGG" + "N" * 30 + text(9, 300)
    df = spark.createDataFrame([(1, s)], "seq_id long, sequence string")
    gc = motifs.gc_windows(df, 100).collect()
    assert {r.w: r.gc for r in gc} == {w: (t.count("G") + t.count("C")) / len(t.replace("N", "")) for w in range(-(-len(s) // 100)) for t in [s[100 * w : 100 * w + 100]]}
    flip = lambda x: x[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    want = []
    for i in range(len(s) - 13):
        d = s[i + 6 : i + 24].find(flip(s[i : i + 6]))
        if d >= 3 and "N" not in s[i : i + 6]:
            want.append((1, i, i + 12 + d, d, s[i : i + 6]))
    assert rows(motifs.inverted_repeats(df, size=64)) == want
    assert rows(thermo.contextual(df, size=64)) == rows(thermo.contextual(df))


def test_contextual_of_repeated_ids(spark):
    one, two = text(10, 300), text(11, 40)
    df = spark.createDataFrame([(1, one), (1, one), (2, two)], "seq_id long, sequence string")
    got = {r.seq_id: r for r in thermo.contextual(df).collect()}
    assert got[1].n_steps == 2 * 299 and got[2].n_steps == 39
    both = thermo.contextual_profile(df).where("seq_id = 1").collect()
    assert got[1].mean_bubble_propensity == round(sum(r.bubble_propensity for r in both) / len(both), 4)

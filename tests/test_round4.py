"""Operators that used to repeat work for each mention of a column, or had a row per base."""

import math

import numpy as np
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.operators import scan
from spanframe.operators.sequence import kernel, thermo, variants
from spanframe.sources import readers


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_split_once(spark):
    text = '{0}\tH\t{1}\t{2}\t90\t.\t+\t.\tgene_id "g{3}"; gene_name "{4}";'
    rows = [text.format("chr1", "gene", 11, 1, "A"), text.format("chrUn", "gene", 11, 2, "B"), text.format("chr2", "exon", "x", 3, "C"),
            text.format("chr2", "CDS", 21, 4, ""), text.format("chrX", "CDS", 21, 5, "E"), "#comment", "short\tline", None]
    made = spark.createDataFrame([(r,) for r in rows], "raw string").select(F.concat(F.col("raw"), F.lit("")).alias("value"))
    found = readers.shape_gtf(made)
    assert _plan(found).count("split(") == 1
    got = sorted((r["chr_id"], r["start_pos"], r["end_pos"], r["gene_symbol"], r["gene_id"], r["feature_type"]) for r in found.collect())
    assert got == [(1, 10, 90, "A", "g1", "gene"), (23, 20, 90, "E", "g5", "cds")]


def _texts(spark):
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("ACGT"), n)) for n in (1, 2, 700, 2300, 5001)] + ["ACGTNNACNGT" * 130, "", None, "acgu" * 300]
    return spark.createDataFrame([*enumerate(made), (50, "ACGTTGCA" * 90), (50, "ACGTTGCA" * 90), (None, "ACGT" * 200)], "seq_id long, sequence string")


def _rows(df, digits=7):
    return sorted(tuple(round(v, digits) + 0.0 if isinstance(v, float) else v for v in r) for r in df.collect())


def test_profile_without_a_row_per_step_in_spark(spark):
    df = _texts(spark).where("seq_id is null or seq_id <> 50")
    micro = {d: round((K.NN_DELTA_H[d] - K.KELVIN_37 * (K.NN_DELTA_S[d] + K.SALT_ENTROPY * math.log(0.15)) / 1000.0) * 1e6) for d in K.DINUCLEOTIDES}
    for digits in (2, 6):
        fast = thermo.thermo_profile(df, 150.0, 512, digits)
        slow = thermo._shared_profile(df, micro, 512, digits)
        assert fast.columns == slow.columns and _rows(fast) == _rows(slow)
    plan = _plan(thermo.thermo_profile(spark.createDataFrame([(1, "ACGT")], "seq_id long, sequence string")))
    assert plan.count("MapInArrow") == 1  # the rows of sequences with an id of their own
    both = thermo.thermo_profile(_texts(spark).where("seq_id = 50"), 150.0, 512, 6)
    assert _rows(both) == _rows(thermo._shared_profile(_texts(spark).where("seq_id = 50"), micro, 512, 6))


def test_running_sum_carries_over_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(1, "ACGTTGCANACG" * 40), (2, "GGCATN" * 9), (3, "TTAGC" * 50)], "seq_id long, sequence string").coalesce(1)
    whole = _rows(thermo.thermo_profile(df, size=8192))
    assert whole == _rows(thermo.thermo_profile(df, size=16))
    steps = kernel.RunningSteps(list(range(1, 17)))
    piece = lambda text, start, n: kernel.Pieces(np.frombuffer(text, np.uint8), *(np.array([v]) for v in (0, len(text), n, start, min(n, start + 4), start)))
    first, second = steps(piece(b"ACGTA", 0, 7)), steps(piece(b"ACG", 4, 7))
    assert first[3].tolist() == [2, 9, 21, 34] and second[3].tolist() == [36, 43] and second[1].tolist() == [4, 5]
    assert steps(piece(b"AAC", 0, 3))[3].tolist() == [1, 3]


def test_window_tracks_without_a_row_per_step(spark):
    df = _texts(spark)
    got = {(r["seq_id"], r["start_pos"]): r for r in thermo.window_tracks(df.where("seq_id <> 50")).collect()}
    keyed = thermo._track_windows(df.where("seq_id <> 50"), 1000)
    want = thermo._base_tracks(keyed).drop("sequence").join(thermo._shared_sums(keyed), ["seq_id", "win"]).select("seq_id", "win", "melting_temp", *thermo._bend_and_period()).collect()
    assert len(got) == len(want) > 8
    for r in want:
        for name in ("melting_temp", "curvature", "periodicity_power"):
            assert abs(got[r["seq_id"], r["win"]][name] - r[name]) < 1e-9
    assert _plan(thermo.window_tracks(df)).count("MapInArrow") == 1
    assert [r["seq_id"] for r in thermo.window_tracks(df.where("seq_id = 50")).collect()] == [50, 50]


def test_variant_windows_are_put_together_once(spark):
    sequences = spark.createDataFrame([(k, "ACGTTGCATTAACGCG" * 12) for k in range(6)], "seq_id long, sequence string")
    asked = spark.createDataFrame([(k, k, 40 + k, "ACGTTGCATTAACGCG"[(40 + k) % 16], "G") for k in range(6)] + [(9, 99, 3, "A", "C")], "variant_id long, seq_id long, pos int, ref string, alt string")
    made = variants.variant_deltas(asked, sequences)
    assert "ExistingRDD" not in _plan(made) and "LocalTableScan" not in _plan(made)  # neither table is read again
    got = {r["variant_id"]: r for r in made.collect()}
    assert len(got) == 7 and got[9]["reject"] == "reference_mismatch" and all(got[k]["reject"] is None and got[k]["delta_dg37"] is not None for k in range(6))


def test_few_cut_points_for_given_buckets(spark):
    rows = [(g, float(v * v % 977)) for g in range(5) for v in range(40 + g)] + [(None, 1.0), (1, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    found = scan.exact_quantiles(df, ["g"], "v", {"low": 0.25, "median": 0.5}, buckets=8, moments=True)
    assert "0.998" not in _plan(found)  # of 1023 shares
    for r in found.collect():
        own = np.array([v for g, v in rows if g == r["g"] and v is not None])
        assert r["n"] == len(own) and abs(r["median"] - np.median(own)) < 1e-9 and abs(r["low"] - np.quantile(own, 0.25)) < 1e-9 and abs(r["sd"] - own.std(ddof=1)) < 1e-9
    monkey = scan.BUCKET_VALUES
    try:
        scan.BUCKET_VALUES = 7
        again = scan.exact_quantiles(df, ["g"], "v", {"low": 0.25, "median": 0.5}, buckets=8, moments=True)
        assert _rows(again) == _rows(found)
    finally:
        scan.BUCKET_VALUES = monkey

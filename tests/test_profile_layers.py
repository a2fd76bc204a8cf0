"""Layers of the gene profile on odd rows: no symbol, repeated symbols, no windows, nulls."""

import math

import pytest

from spanframe.operators import genes as gn


def test_intrinsic_and_protein_layers(spark):
    genes = spark.createDataFrame(
        [("g1", "Abc", "b", 1, 0, 4000), ("g2", None, "b", 1, 500, 1500), ("g3", "XYZ", "b", 2, 0, 1000), ("g4", None, "b", 1, 10, 10)],
        "gene_id string, symbol string, build string, chr_id int, start_pos long, end_pos long")
    windows = spark.createDataFrame([("b", 1, 0, 1000, 0.4), ("b", 1, 1000, 2000, None), ("b", 1, 3000, 4000, 0.6)], "build string, chr_id int, start_pos long, end_pos long, gc double")
    constraint = spark.createDataFrame([("ABC", 0.2, 1.5), ("abc", 0.4, None), (None, 9.0, 9.0)], "symbol string, loeuf double, mis_z double")
    rows = {r["gene_id"]: r for r in gn.intrinsic_layer(genes, windows, constraint, levels=[1024]).collect()}
    assert len(rows) == 4 and rows["g1"]["loeuf"] == 0.4 and rows["g1"]["mis_z"] == 1.5 and rows["g1"]["gc_body"] == pytest.approx(0.5)
    assert rows["g1"]["gene_length_log_kb"] == pytest.approx(2.0) and rows["g4"]["gene_length_log_kb"] is None
    assert rows["g2"]["loeuf"] is None and rows["g2"]["gc_body"] == pytest.approx(0.4) and rows["g3"]["gc_body"] is None

    abundance = spark.createDataFrame([("abc", 3.0), ("ABC", 7.0), (None, 99.0), ("xyz", None)], "symbol string, abundance_ppm double")
    costs = spark.createDataFrame([("abc", 0.25, None, 20.0), ("xyz", None, None, None)], "symbol string, frac_expensive double, frac_very_expensive double, ecpa_b20 double")
    out = {r["gene_id"]: tuple(r)[1:] for r in gn.protein_profile(genes, abundance, costs).collect()}
    assert out["g1"] == (math.log2(8), 0.25, 20.0) and out["g3"] == (0.0, 0.0, None) and out["g2"] == out["g4"] == (None, None, None)

"""Constant reference tables as DataFrames, for filtered lookups and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanframe.functions import constants as K


def nn_parameters(spark: SparkSession) -> DataFrame:
    """Nearest-neighbour energies per duplex type and step."""
    kinds = {
        "dna_dna": (K.NN_DELTA_H, K.NN_DELTA_S, K.NN_DELTA_G37), "rna_rna": (K.RNA_DELTA_H, K.RNA_DELTA_S, K.RNA_DELTA_G37),
        "rna_dna": (K.HYBRID_DELTA_H, K.HYBRID_DELTA_S, K.HYBRID_DELTA_G37),
    }
    rows = [(k, d, float(h[d]), float(s[d]), float(g[d])) for k, (h, s, g) in kinds.items() for d in K.DINUCLEOTIDES]
    return spark.createDataFrame(rows, "duplex string, dinucleotide string, delta_h double, delta_s double, delta_g_37 double")


def dinucleotide_properties(spark: SparkSession) -> DataFrame:
    rows = [(name, d, float(table[d])) for name, table in K.STEP_PROPERTIES.items() for d in K.DINUCLEOTIDES]
    return spark.createDataFrame(rows, "property string, dinucleotide string, value double")


def amino_acids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(K.AMINO_ACIDS), "letter string, code string, name string, mass double, volume int, area int, hydropathy double, "
        "interface double, consensus double, side_pka double, charge double, cost double")


def chromosomes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.CHROMOSOME_IDS.items()), "chr_name string, chr_id int")

"""Writers: partitioned layers, per-group exports and the wide matrix with its null audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.operators.quality import null_audit


def write_layer(df: DataFrame, path: str, mode: str = "overwrite", slice_bp: int = 16_000_000) -> None:
    """Layer partitioned by build and chromosome, sorted by start.

    A chromosome is split over position slices, so the largest one (or a hot
    one) is written by many tasks instead of one.
    """
    (
        df.repartition("build", "chr_id", F.floor(F.col("start_pos") / slice_bp))
        .sortWithinPartitions("build", "chr_id", "start_pos")
        .write.mode(mode).partitionBy("build", "chr_id").parquet(path)
    )


def export_by(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """One directory of Parquet files per value of ``column``."""
    df.write.mode(mode).partitionBy(column).parquet(path)


def export_matrix(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write the wide matrix and return the null audit of what was written."""
    df.write.mode(mode).parquet(path)
    return null_audit(df.sparkSession.read.schema(df.schema).parquet(path))

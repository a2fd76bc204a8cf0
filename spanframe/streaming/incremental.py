"""Incremental loading: new files of a layer are appended once, then the touched bins are refreshed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.coords import bin_start
from spanframe.operators.overlap import KEYS


def incremental_load(
    spark: SparkSession, source: str, schema: str, layer_path: str, checkpoint: str, resolution: int = 1000, file_format: str = "parquet",
    bins_path: str | None = None,
):
    """Process all new files below ``source`` and stop.

    The file log in ``checkpoint`` remembers what was loaded. Each batch goes to
    its own ``batch_id`` partition with dynamic overwrite, so a replayed batch
    replaces itself. Per-batch bin counts are written the same way; the current
    bins are their sum (``current_bins``), which never rereads the layer.
    """
    bins_path = bins_path or layer_path.rstrip("/") + "_bins"

    def store(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumn("batch_id", F.lit(batch_id))
        options = {"partitionOverwriteMode": "dynamic"}
        tagged.write.mode("overwrite").options(**options).partitionBy("batch_id").parquet(layer_path)
        binned = tagged.groupBy("batch_id", *KEYS, bin_start(F.col("start_pos"), resolution).alias("bin_start")).agg(
            F.count(F.lit(1)).alias("n")
        )
        binned.write.mode("overwrite").options(**options).partitionBy("batch_id").parquet(bins_path)

    return (
        spark.readStream.format(file_format).schema(schema).load(source)
        .writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_bins(spark: SparkSession, bins_path: str) -> DataFrame:
    """Bin counts over all batches loaded so far."""
    return spark.read.parquet(bins_path).groupBy(*KEYS, "bin_start").agg(F.sum("n").alias("n"))

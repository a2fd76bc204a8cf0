"""Helpers shared by the training-data operators: folders, document batches, folds and labelled samples."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse
from urllib.request import url2pathname

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels take at once; a longer text is one block of its own.
BLOCK_BYTES = 1 << 19


def bound_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of at most 1000 rows and about 16 MB, so that a task's memory does not follow the lengths of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir`` (or the context's own); in local mode without either, in the warehouse folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mounted(path: str) -> str:
    """The local name of a shared folder that every executor has mounted; the file formats that need seek and mmap use it."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{url.scheme} paths cannot be memory-mapped; name a mounted folder")
    return url2pathname(url.path) if url.scheme else path


def write_whole(path: str, write) -> None:
    """Write a file under a name of this attempt and rename it, so a retried task never leaves half a file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        write(out)
    os.replace(part, path)


def fold(column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def labelled_ids(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """Ids outside the held fold with their one label, 0 or 1; ids with both are dropped."""
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
        .where(fold("doc_id", folds) != held).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    )


def labelled(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """A bounded sample of labelled rows outside the held fold: (doc_id, text, *extra, label, weight).

    About ``per_class`` ids of each class are taken, by hash of the id (all, where a class has fewer). Rows with a null id,
    label or text are left out, repeated label rows count once, ids with both labels are dropped; weight is the number
    of rows that one stands for. The ids that go
    to the executors are at most about 2 * per_class, whatever the size of the tables.
    """
    ids = labelled_ids(labels, label, folds, held)
    counts = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    share = F.lit(1.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, per_class / n))).otherwise(share)
    ids = ids.withColumn("weight", 1 / share).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("weight") < (1 << 30))
    return documents.select("doc_id", "text", *extra).where("text is not null").join(F.broadcast(ids), "doc_id")


def release_memory() -> None:
    """Give freed memory back to the system; a worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, in order; column ``text`` becomes binary without nulls."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        text = batch.column(at).cast(pa.large_binary()).fill_null(b"")
        start, size = 0, 0
        lengths = pa.compute.binary_length(text).to_numpy(zero_copy_only=False)
        columns, names = [*batch.columns], batch.schema.names
        columns[at] = text
        whole = pa.RecordBatch.from_arrays(columns, names=names)
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield whole.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < len(lengths):
            yield whole.slice(start)
        del batch, text, columns, whole
    release_memory()

"""Tables of counters or bits of a fixed size, filled by all tasks and combined on the way to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Counters in one row; also the largest size that a histogram counts by itself.
SLICE = 1 << 14


def _fold(df: DataFrame, op: np.ufunc, *keys: str) -> DataFrame:
    """Combine rows (slot, salt, counts) that share the keys; a task holds one array for each slot."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(batch.column(0).to_pylist(), batch.column(2)):
                values = np.frombuffer(counts.as_buffer(), np.int64)
                held[slot] = op(held[slot], values) if slot in held else values.copy()
        if held:
            yield pa.RecordBatch.from_pydict({"slot": pa.array(list(held), pa.int32()), "salt": pa.array([0] * len(held), pa.int32()), "counts": [v.tobytes() for v in held.values()]})

    return df.repartition(*keys).mapInArrow(fold, "slot int, salt int, counts binary")


def fold_table(df: DataFrame, op: np.ufunc, size: int) -> np.ndarray:
    """Fold in two steps, so that no task reads a slot of all tasks, and fetch the table: ``size`` numbers, whatever the input."""
    out = np.zeros(size, np.int64)
    for r in _fold(_fold(df, op, "slot", "salt"), op, "slot").collect():
        out[r["slot"] * SLICE : (r["slot"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return out


def table_rows(table: np.ndarray) -> pa.RecordBatch:
    part = TaskContext.get().partitionId() % 32
    full = [i for i in range(len(table) // SLICE) if table[i * SLICE : (i + 1) * SLICE].any()]
    return pa.RecordBatch.from_pydict({"slot": pa.array(full, pa.int32()), "salt": pa.array([part] * len(full), pa.int32()), "counts": [table[i * SLICE : (i + 1) * SLICE].astype(np.int64).tobytes() for i in full]})

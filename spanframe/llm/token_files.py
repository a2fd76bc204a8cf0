"""Operator 4: token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped for reading.

Layout of a folder, one group of files for each partition, partitions in ascending order of the document id:

* ``part-00000.ids``  flat little-endian unsigned integers (16 bits if the vocabulary fits, else 32), no header
* ``part-00000.off``  int64 offsets of the documents in this file, one more than documents
* ``part-00000.doc``  int64 document ids; the least int64 stands for null
* ``manifest.json``   integer width, end id and, for each partition, its counts and its bases (prefix sums of the counts)

Defined results: a null text is an empty document (the end id alone); null ids come first; rows with equal ids keep one
place each, ordered by a hash of the text, then the text; an empty table gives a manifest without partitions; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.common import mounted, text_blocks, write_whole
from spanframe.llm.tokens import encoder

_NULL = np.iinfo(np.int64).min


def _file(folder: str, part: int, kind: str) -> str:
    return os.path.join(folder, f"part-{part:05d}.{kind}")


def write_token_files(documents: DataFrame, tokenizer: str, path: str, end_id: int) -> list[dict]:
    """Encode ``documents`` (doc_id, text) into files under ``path``, a mounted shared folder; returns the manifest's partitions.

    One shuffle orders the texts by id; every task writes its own files under attempt names and renames them, so lost
    tasks are simply run again. The driver sees one row of counts for each partition.
    """
    folder = mounted(path)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        width = np.dtype("<u2" if max(encode.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4")
        lengths, ids = [], []

        def body(out) -> None:
            for block in text_blocks(batches):
                flat, offsets = encode.encode(block.column("text"))
                out.write(np.insert(flat, offsets[1:], end_id).astype(width).tobytes())
                lengths.append(np.diff(offsets) + 1)
                ids.append(block.column("doc_id").cast(pa.int64()).fill_null(_NULL).to_numpy())

        write_whole(_file(folder, part, "ids"), body)
        if not ids:
            os.remove(_file(folder, part, "ids"))
            return
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        write_whole(_file(folder, part, "off"), lambda out: out.write(offsets.tobytes()))
        write_whole(_file(folder, part, "doc"), lambda out: out.write(np.concatenate(ids).astype("<i8").tobytes()))
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(offsets) - 1], "tokens": [int(offsets[-1])], "bits": [8 * width.itemsize]})

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order)
        .sortWithinPartitions(*order, F.col("text").asc_nulls_first()).mapInArrow(parts, "part long, docs long, tokens long, bits long").collect()
    )
    found, base_doc, base = [], 0, 0
    for r in sorted(rows):
        found.append({"part": r["part"], "docs": r["docs"], "tokens": r["tokens"], "base_doc": base_doc, "base": base})
        base_doc, base = base_doc + r["docs"], base + r["tokens"]
    manifest = {"bits": rows[0]["bits"] if rows else 16, "end_id": end_id, "docs": base_doc, "tokens": base, "parts": found}
    write_whole(os.path.join(folder, "manifest.json"), lambda out: out.write(json.dumps(manifest).encode()))
    return found


class TokenFiles:
    """Random access to a folder: ``ids(i)`` is the i-th document, mapped, not read whole."""

    def __init__(self, path: str):
        self.folder = mounted(path)
        with open(os.path.join(self.folder, "manifest.json"), encoding="utf-8") as f:
            self.manifest = json.load(f)
        self.bases = [p["base_doc"] for p in self.manifest["parts"]]

    def __len__(self) -> int:
        return self.manifest["docs"]

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mapped ids, offsets and document ids of the k-th partition."""
        number = self.manifest["parts"][k]["part"]
        kinds = (("ids", f"<u{self.manifest['bits'] // 8}"), ("off", "<i8"), ("doc", "<i8"))
        return tuple(np.memmap(_file(self.folder, number, kind), dtype=t, mode="r") for kind, t in kinds)

    def ids(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = bisect_right(self.bases, i) - 1
        ids, offsets, _ = self.part(k)
        at = i - self.bases[k]
        return ids[offsets[at] : offsets[at + 1]]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the mapped files, one task for each partition."""
    n = len(TokenFiles(path).bases)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = TokenFiles(path)
        for k in (int(k) for batch in batches for k in batch.column(0).to_pylist()):
            ids, offsets, docs = files.part(k)
            for at in range(0, len(docs), 10_000):
                own, ends = docs[at : at + 10_000], np.asarray(offsets[at : at + 10_001])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(own, pa.int64(), mask=own == _NULL), "start": ends[:-1] + files.manifest["parts"][k]["base"],
                        "n_tokens": np.diff(ends), "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    return spark.range(0, n, 1, max(1, n)).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")

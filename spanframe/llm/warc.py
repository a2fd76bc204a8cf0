"""Operator 9: WARC archives: a writer with revisit records and a salvage reader.

The writer makes one gzip member for each record, files of a bounded size, and a revisit record instead of a payload that another
page carries. The reader checks every record (gzip checksum, version line, lengths, block digest). After a failed check it searches for
the next valid member or, in plain files, version line, goes on there, and reports the bytes between as a quarantined gap.

Defined results: a null payload is empty; among equal payloads of at least ``least`` bytes the rows with the largest page_id are responses (all
rows that repeat that id), the others revisit it; rows whose group has only null ids are responses; a null or repeated page_id gives a record each;
an empty table gives no file; an unreadable file is one gap; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import mmap
import os
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import mounted, stored, write_whole

#: Compressed bytes after which the writer begins a new file.
FILE_BYTES = 64 << 20
VERSION = b"WARC/1.1"
_PAGE = "urn:page:"


class Broken(Exception):
    """A record that failed a check."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in headers.items()), f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member; the header carries no time, so equal input gives equal bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """The response record of a page, or its revisit record if it refers to another page."""
    payload = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{_PAGE}{'null' if page_id is None else page_id}>",
        "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~-._"),
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest(payload)}", "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{_PAGE}{refers_to}>"}
        return record(headers, http)
    return record(headers, http + payload)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses. Only digests and ids are grouped; a hot digest is one row after that."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    shared = own.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    target = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first"))
    return own.join(shared, "digest", "left").select("page_id", "url", "html", target.alias("refers_to"))


def write_archives(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, html, refers_to) as .warc.gz files under a mounted shared folder; returns the stored (file, records, bytes)."""
    folder = mounted(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        todo = (r for batch in batches for small in range(0, batch.num_rows, 200) for r in batch.slice(small, 200).to_pylist())
        held = next(todo, None)
        while held is not None:
            records = 0

            def body(out) -> None:
                nonlocal held, records
                out.write(member(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:file:{part}-{number}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                while held is not None and out.tell() < file_bytes:
                    out.write(member(page_record(held["page_id"], held["url"], held["html"], held["refers_to"])))
                    records, held = records + 1, next(todo, None)

            name = os.path.join(folder, f"part-{part:05d}-{number:05d}.warc.gz")
            write_whole(name, body)
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [os.path.getsize(name)]})
            number += 1

    return stored(rows.select("page_id", "url", "html", "refers_to").mapInArrow(write, "file string, records long, bytes long"), "archives")


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    if data[at : at + 7] != b"WARC/1.":
        raise Broken("no version line")
    end = data.find(b"\r\n\r\n", at, at + (1 << 20))
    if end < 0:
        raise Broken("header does not end")
    try:
        lines = bytes(data[at:end]).decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        length = int(headers["content-length"])
    except (ValueError, KeyError):
        raise Broken("bad header") from None
    start = end + 4
    block = bytes(data[start : start + length])
    if length < 0 or len(block) < length or data[start + length : start + length + 4] != b"\r\n\r\n":
        raise Broken("length does not fit")
    if (want := headers.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != digest(block):
        raise Broken("block digest differs")
    return headers, block, start + length + 4


def _inflate(data, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and its end."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            chunk = data[pos : pos + (1 << 16)]
            if not chunk:
                raise Broken("member is cut off")
            out.append(z.decompress(chunk))
            pos += len(chunk)
    except zlib.error as e:
        raise Broken(f"gzip: {e}") from None
    return b"".join(out), pos - len(z.unused_data)


def _resume(data, at: int) -> int:
    """Where the next record that may be valid begins, from ``at`` on; the end of the data if there is none."""
    zipped = data[:2] == b"\x1f\x8b"
    while True:
        member_at, line_at = data.find(b"\x1f\x8b\x08", at), data.find(b"WARC/1.", at)
        if line_at >= 0 and (member_at < 0 or line_at < member_at) and not zipped:
            return line_at
        if member_at < 0:
            return line_at if line_at >= 0 and not zipped else len(data)
        try:
            if zlib.decompressobj(31).decompress(data[member_at : member_at + 4096], 16).startswith(b"WARC/1."):
                return member_at
        except zlib.error:
            pass
        at = member_at + 1


def salvage(data) -> Iterator[tuple[str, int, int, dict[str, str] | str, bytes]]:
    """("record", start, end, headers, block) and ("gap", start, end, reason, b"") for the bytes of a file, plain or of gzip members."""
    at, size = 0, len(data)
    while at < size:
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                content, end = _inflate(data, at)
                inner, found = 0, []
                while inner < len(content):
                    headers, block, inner = _parse(content, inner)
                    found.append((headers, block))
                yield from (("record", at, end, headers, block) for headers, block in found)
            else:
                headers, block, end = _parse(data, at)
                yield "record", at, end, headers, block
            at = end
        except Broken as e:
            end = _resume(data, at + 1)
            yield "gap", at, end, str(e), b""
            at = end


def _page(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").removeprefix(_PAGE)
    return int(text) if text.lstrip("-").isdigit() else None


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the files of a table (file string), one file in a task at a time.

    Rows: kind (record or gap), file, start, stop, page_id, url, payload_bytes, payload_digest, record_type, refers_to, reason[, payload].
    Responses are measured anew from the payload read; revisits take length and digest from their headers.
    """
    schema = "kind string, file string, start long, stop long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, reason string" + ", payload binary" * with_payload
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * with_payload]
    names = [x.split()[0] for x in schema.split(", ")]

    def row(name: str, found) -> tuple | None:
        kind, start, stop, headers, block = found
        if kind == "gap":
            return (kind, name, start, stop, None, None, None, None, None, None, headers, *[None] * with_payload)
        record_type = headers.get("warc-type")
        if record_type not in ("response", "revisit"):
            return None
        payload = block.partition(b"\r\n\r\n")[2]
        if record_type == "response":
            length, sha = len(payload), digest(payload)
        else:
            length, sha = int(headers.get("x-payload-length", 0)), headers.get("warc-payload-digest", "").removeprefix("sha1:")
        refers = _page(headers.get("warc-refers-to")) if record_type == "revisit" else None
        return (kind, name, start, stop, _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), length, sha, record_type, refers, None, *[payload] * with_payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for name in (x for batch in batches for x in batch.column(0).to_pylist()):
            if not os.path.getsize(name):
                continue
            with open(name, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                rows: list[tuple] = []
                for found in salvage(data):
                    if (made := row(name, found)) is not None:
                        rows.append(made)
                    if len(rows) >= 500:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return files.select("file").repartitionByRange("file").mapInArrow(read, schema)

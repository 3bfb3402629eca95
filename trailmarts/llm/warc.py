"""WARC archives: one gzip member per record, written by tasks and read back record by record.

Of the pages with equal payloads of at least ``least`` bytes, the one with the
largest id is kept as a response; the others are revisits that name it and
carry no payload. Payloads are held equal by SHA-1 and length; the table of
repeated payloads is an aggregate with one row per payload, joined so that a
payload of very many pages can be split over tasks.

The reader inflates a member in steps, frames the record by its
Content-Length and checks block and payload digests; it holds one record.

Defined results: a null page is an empty payload; of pages without id none is
a kept page while another has an id, and all are responses if none has one;
rows that repeat the kept id are responses too; a null address is written as
the record's own id, and characters not allowed in a header are escaped; an
empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmarts.session import fresh_dir, stored

from .common import Folder, one_task_each, partition, small_batches, utf8

LEAST_BYTES = 1000
FILE_BYTES = 64 << 20  # compressed
STEP = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the pages carry no time
FILES = "name string, n_records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_files = pa.schema([("name", pa.string()), ("n_records", pa.int64())])
_records = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_in(name: str) -> int | None:
    body = name.removeprefix("<urn:page:").removesuffix(">")
    return int(body) if body else None


def _escaped(url: str) -> str:
    """Bytes outside visible ASCII as %XX."""
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in utf8(url))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record before compression. A revisit has the response's head only, which states the payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_escaped(url) if url else name_of(page_id)[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        fields += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name_of(refers_to)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a file, one after the other."""
    data = stream.read(STEP)
    while data:
        inflate, parts = zlib.decompressobj(wbits=31), []
        while not inflate.eof:
            if not data:
                raise ValueError("an archive ends within a record")
            parts.append(inflate.decompress(data))
            data = inflate.unused_data if inflate.eof else stream.read(STEP)
        yield b"".join(parts)
        data = data or stream.read(STEP)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; both digests are checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    n = int(fields["content-length"])
    if not found or not head.startswith(b"WARC/1.") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record, or its length is wrong")
    block = rest[:n]
    if fields["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError(f"block digest of {fields['warc-record-id']} does not match")
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{hashlib.sha1(block.partition(b'\r\n\r\n')[2]).hexdigest()}":
        raise ValueError(f"payload digest of {fields['warc-record-id']} does not match")
    return fields, block


def write(pages: DataFrame, uri: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Write all ``pages``; one row per file."""
    small_batches(pages.sparkSession)
    page = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    page = page.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "n": F.octet_length("html")})
    repeated = (
        page.where(F.col("n") >= least).groupBy("digest", "n").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("kept"))
        .where("copies > 1").select("digest", "n", "kept")
    )
    planned = page.join(repeated, ["digest", "n"], "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("kept")), None).otherwise(F.col("kept")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seq, n = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"pages-{partition():06d}-{seq:06d}.warc.gz"
                    out, seq, n = Folder(uri).write(name), seq + 1, 0
                gz = zlib.compressobj(wbits=31)
                out.write(gz.compress(record(row["page_id"], row["url"], utf8(row["html"]), row["digest"], row["refers_to"])) + gz.flush())
                n += 1
                if out.size >= FILE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], schema=_files)
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], schema=_files)

    return stored(planned.mapInArrow(run, FILES), "warc-files")


def read(files: DataFrame, uri: str, rows: int = 500) -> DataFrame:
    """One row per record of the archives, length and digest those of the full payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                found = []
                with Folder(uri).read(name) as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", block)[1])
                        refers = fields.get("warc-refers-to")
                        found.append((id_in(fields["warc-record-id"]), size, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], None if refers is None else id_in(refers), fields["warc-target-uri"]))
                        if len(found) == rows:
                            yield _batch(found)
                            found = []
                if found:
                    yield _batch(found)

    return one_task_each(files.select("name"), files.count()).mapInArrow(run, RECORDS)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _records, strict=True)], schema=_records)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a folder of their own and read them back."""
    uri = fresh_dir(pages.sparkSession, "warc")
    return read(write(pages, uri), uri)

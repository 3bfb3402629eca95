"""Token-id files: texts encoded, coded by Simple-8b and written in id order; read back from the files.

A file is a row of segments. A segment holds whole documents: a header with
the counts, then document ids, which of them are null, token counts, the first
word of each block, the words and the exceptions. Segments end at about a
million ids and files at about 64 MB, so neither grows with the input.

Defined results: a null or empty text is its end id alone; rows without id come
first; rows that share an id are ordered by text; an empty table gives no file
and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmarts.session import fresh_dir, stored

from . import simple8b
from .common import Folder, one_task_each, partition, small_batches
from .tokens import encoded

MAGIC = b"S8BIDS1\n"
HEADER = struct.Struct("<8s5Q")  # magic, documents, ids, blocks, words, exceptions
SEGMENT_IDS = 1 << 20
FILE_BYTES = 64 << 20

FILES = "part int, seq int, name string, n_docs long, n_ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def segment(doc_ids: list[int | None], coded: list[np.ndarray]) -> bytes:
    """One segment of documents and their ids."""
    p = simple8b.encode(np.concatenate(coded))
    return b"".join([
        HEADER.pack(MAGIC, len(doc_ids), p.n, len(p.blocks), len(p.words), len(p.exceptions)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(),
        np.array([len(x) for x in coded], "<u8").tobytes(), p.blocks.astype("<u4").tobytes(), p.words.astype("<u8").tobytes(), p.exceptions.astype("<u8").tobytes(),
    ])


def segments(stream) -> Iterator[tuple[list[int | None], np.ndarray, simple8b.Packed]]:
    """The segments of a file: document ids, their token counts, the packed ids."""

    def take(kind: str, n: int) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        data = stream.read(size)
        if len(data) != size:
            raise ValueError("a token-id file ends within a segment")
        return np.frombuffer(data, kind)

    while head := stream.read(HEADER.size):
        if len(head) != HEADER.size or head[:8] != MAGIC:
            raise ValueError("not a segment of token ids")
        _, docs, n, blocks, words, exceptions = HEADER.unpack(head)
        ids, absent, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
        packed = simple8b.Packed(n, take("<u4", blocks), take("<u8", words), take("<u8", exceptions))
        yield [None if a else int(i) for i, a in zip(ids, absent, strict=True)], lengths.astype(np.int64), packed


def write(documents: DataFrame, tokenizer: str, uri: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Encode and write ``documents`` in ascending order of ``doc_id``; one row per file, (part, seq) in that order."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = partition(), 0, None
        ids, coded, size, docs, total = [], [], 0, 0, 0

        def flush() -> None:
            nonlocal out, size, docs, total
            if out is None:
                out = Folder(uri).write(f"ids-{part:06d}-{seq:06d}.s8b")
            out.write(segment(ids, coded))
            docs, total, size = docs + len(ids), total + size, 0
            ids.clear()
            coded.clear()

        def done() -> pa.RecordBatch:
            nonlocal out, seq, docs, total
            out.close()
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "name": f"ids-{part:06d}-{seq:06d}.s8b", "n_docs": docs, "n_ids": total}], schema=_schema)
            out, seq, docs, total = None, seq + 1, 0, 0
            return row

        for keys, tokens, edges in encoded(batches, tokenizer, end_id):
            for key, a, b in zip(keys, edges.tolist(), edges[1:].tolist()):
                ids.append(key)
                coded.append(tokens[a:b])
                size += b - a
                if size >= SEGMENT_IDS:
                    flush()
                    if out.size >= FILE_BYTES:
                        yield done()
        if ids:
            flush()
        if out is not None:
            yield done()

    ordered = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, FILES), "id-files")


_schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_documents = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])


def read(files: DataFrame, uri: str) -> DataFrame:
    """Per document, decoded from the files: place of its first id among all, number of ids, their crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = row["before"]
                with Folder(uri).read(row["name"]) as stream:
                    for ids, lengths, packed in segments(stream):
                        tokens = simple8b.decode(packed).astype("<u4")
                        ends = np.cumsum(lengths)
                        starts = ends - lengths
                        sums = [zlib.crc32(tokens[a:b]) for a, b in zip(starts, ends, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts + at), pa.array(lengths), pa.array(sums, pa.int64())], schema=_documents)
                        at += int(lengths.sum())

    # one row per file
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("name", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    return one_task_each(placed, files.count()).mapInArrow(run, DOCUMENTS)


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``documents`` to a folder of their own and read them back."""
    uri = fresh_dir(documents.sparkSession, "token-ids")
    return read(write(documents, tokenizer, uri), uri)

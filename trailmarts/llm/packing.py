"""Cost-balanced packing of token ids into sequences of fixed capacity.

Attention over a piece of n tokens is estimated as linear * n + quadratic * n^2,
and a sequence costs what its pieces cost. Whole multiples of the capacity are
cut off a document first; each fills a sequence. What remains is pooled, and a
pool is packed in descending length: each piece goes to the sequence of lowest
cost that has room for it, or is cut over the sequences with room if none has.
A pool has as many sequences as its tokens fill; the surplus goes to the next
pool, so only the last sequence of a task is padded.

Each task packs the documents it reads, so there is no shuffle. Pools have a
fixed number of tokens.

Defined results: a null or empty text is its end id alone; rows that share an
id are packed as documents of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partition, small_batches
from .tokens import encoded

POOL_SEQUENCES = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
_schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("cost", pa.float64())])
_with_ids = _schema.append(pa.field("ids", pa.binary()))


def balance(lengths: list[int], sequences: int, capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Pieces (document, start within it, length, sequence), and (document, start) of what found no room."""
    room = np.full(sequences, capacity, np.int64)
    cost = np.zeros(sequences)
    placed, left = [], []
    for doc in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, rest = 0, lengths[doc]
        while rest:
            fits = room >= rest
            if not fits.any():
                fits = room > 0
                if not fits.any():
                    left.append((doc, start))
                    break
            seq = int(np.argmin(np.where(fits, cost, np.inf)))
            n = min(rest, int(room[seq]))
            placed.append((doc, start, n, seq))
            room[seq] -= n
            cost[seq] += linear * n + quadratic * n * n
            start, rest = start + n, rest - n
    return placed, left


def pack(documents: DataFrame, tokenizer: str, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds its ids as little-endian unsigned 32-bit integers."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_sequence = partition() << 40
        pool, pooled, out = [], 0, []  # pool: id, ids, start of what is left

        def add(key, ids: np.ndarray, start: int, n: int, sequence: int, offset: int) -> None:
            part = ids[start:start + n]
            out.append((key, start, n, zlib.crc32(part), len(ids), sequence, offset, linear * n + quadratic * n * n, *([part.tobytes()] if with_ids else [])))

        def settle(sequences: int) -> None:
            nonlocal pool, next_sequence, pooled
            placed, left = balance([len(ids) - start for _, ids, start in pool], sequences, capacity, linear, quadratic)
            offsets = np.zeros(sequences, np.int64)
            for doc, start, n, seq in placed:
                key, ids, base = pool[doc]
                add(key, ids, base + start, n, next_sequence + seq, int(offsets[seq]))
                offsets[seq] += n
            next_sequence += sequences
            pool = [(pool[doc][0], pool[doc][1], pool[doc][2] + start) for doc, start in left]
            pooled = sum(len(ids) - start for _, ids, start in pool)

        def flush() -> pa.RecordBatch:
            schema = _with_ids if with_ids else _schema
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for keys, tokens, edges in encoded(batches, tokenizer, end_id):
            for key, a, b in zip(keys, edges.tolist(), edges[1:].tolist()):
                ids, n = tokens[a:b], b - a
                whole = n // capacity * capacity
                for start in range(0, whole, capacity):
                    add(key, ids, start, capacity, next_sequence, 0)
                    next_sequence += 1
                if whole < n:
                    pool.append((key, ids, whole))  # a view: a step's ids stay until its pool is packed
                    pooled += n - whole
                if pooled >= POOL_SEQUENCES * capacity:
                    settle(pooled // capacity)
            if out:
                yield flush()
        for sequences in (pooled // capacity, 1):
            if pool and sequences:
                settle(sequences)
        if out:
            yield flush()

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))

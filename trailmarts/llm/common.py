"""Helpers of this package: bounded batches, shared binary files, sizes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000  # rows of one Arrow batch handed to Python: bounds memory when texts are long
SLICE_CHARS = 4_000_000  # characters that one step of a Python loop holds as words


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_CHARS) -> Iterator[list[tuple]]:
    """Rows as tuples, at most ``limit`` characters of the second column together, one row at least."""
    held, size = [], 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            n = len(row[1] or "")
            if held and size + n > limit:
                yield held
                held, size = [], 0
            held.append(row)
            size += n
        if held:
            yield held
            held, size = [], 0


def partition() -> int:
    return TaskContext.get().partitionId()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def crc_fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(0)).cast("int")


class Folder:
    """Binary files in the cluster's shared folder, by any URI that pyarrow can reach.

    A file appears under its name only when it is complete: it is written under
    a name of its own and then renamed, so a repeated or lost task leaves
    either nothing or the same whole file.
    """

    def __init__(self, uri: str):
        self.uri = uri

    def _at(self):
        from pyarrow import fs

        if "://" in self.uri or self.uri.startswith("file:"):
            uri = self.uri if "://" in self.uri else "file://" + self.uri[5:]
            return fs.FileSystem.from_uri(uri)
        return fs.LocalFileSystem(), self.uri

    def write(self, name: str) -> Whole:
        system, root = self._at()
        system.create_dir(root, recursive=True)
        return Whole(system, f"{root}/{name}")

    def read(self, name: str):
        system, root = self._at()
        return system.open_input_stream(f"{root}/{name}", compression=None)


class Whole:
    def __init__(self, system, path: str):
        self.system, self.path, self.own = system, path, f"{path}.{uuid.uuid4().hex}"
        self.out, self.size = system.open_output_stream(self.own), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.own, self.path)


def one_task_each(df: DataFrame, n: int) -> DataFrame:
    """Deal the few rows of ``df`` (file names, say) to ``n`` tasks."""
    return df.repartition(max(1, n))

"""A streaming source of lines whose offset is the set of files with their sizes.

The offset names every file with its size, its time of change and a checksum of
its last bytes. A batch holds what changed between two offsets: of a new file
all lines, of a grown file the lines of the part that was added, of a file that
is shorter, or whose bytes before the added part are others than before, all
lines again. Unchanged files are not opened. The driver lists the files and
reads ``MARK`` bytes of those that changed; lines are read by tasks, in pieces
of at most ``PIECE`` bytes of a file. A file that has no ended line any more gives
no rows, so its earlier lines stay until it has one.

A piece has the lines whose line feed lies in it and looks back for the
beginning of the first, so a line that was half written is read once it is
ended; a last line without its line feed waits for it.
"""

from __future__ import annotations

import fnmatch
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.files import open_folder
from ..sources.transcripts import LINE_BREAK

PIECE = 32 << 20  # bytes of a file that are read at once
SHARE = 32 << 20  # bytes of the pieces that a task reads
OPENING = 1 << 17  # bytes that opening a file counts for
BATCH = 1 << 13  # lines of small files that are handed over together
MARK = 256  # bytes before the end of a file that tell whether it has only grown
BACK = 1 << 16  # bytes read at a time while looking for the beginning of a line
SCHEMA = "path string, mtime_ms bigint, fresh boolean, start bigint, nth bigint, text string"


@dataclass
class Piece(InputPartition):
    path: str
    mtime_ms: int
    fresh: bool  # whether the file is read anew
    start: int
    end: int


@dataclass
class Share(InputPartition):
    """Pieces that one task reads: many small files, or one piece of a large one."""

    pieces: list[Piece]


class GrowingLines(DataSource):
    """Options: ``path`` (a folder), ``pattern`` (of file names), ``piece`` (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def _mark(stream, size: int) -> int:
    stream.seek(max(0, size - MARK))
    return zlib.crc32(stream.read(min(MARK, size)))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.piece = int(options.get("piece", PIECE))
        self.seen: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, folder = open_folder(self.root)
        found = {}
        for f in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern):
                size, changed = f.size, f.mtime_ns // 1_000_000
                before = self.seen.get(f.path)
                if before and before[:2] == [size, changed]:
                    found[f.path] = before
                else:
                    with system.open_input_file(f.path) as stream:
                        found[f.path] = [size, changed, _mark(stream, size)]
        self.seen = found
        return {"files": found}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        system, _ = open_folder(self.root)
        pieces = []
        for path, (size, changed, _) in sorted(end["files"].items()):
            known, before, mark = start["files"].get(path, (0, None, 0))
            if known == size and before == changed:
                continue
            if known >= size:
                known = 0  # shorter, or of the same size but written again
            elif known:
                with system.open_input_file(path) as stream:
                    if _mark(stream, known) != mark:
                        known = 0  # longer, but another file
            for at in range(known, size, self.piece):
                pieces.append(Piece(path, changed, known == 0, at, min(size, at + self.piece)))
        shares, room = [], 0
        for p in pieces:
            cost = p.end - p.start + OPENING
            if not shares or cost > room:
                shares.append(Share([]))
                room = SHARE
            shares[-1].pieces.append(p)
            room -= cost
        return shares

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.root)
        held: list[pa.RecordBatch] = []
        for p in share.pieces:
            held += self._lines(system, p)
            if sum(b.num_rows for b in held) >= BATCH:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def _lines(self, system, p: Piece) -> Iterator[pa.RecordBatch]:
        with system.open_input_file(p.path) as stream:
            first = _line_start(stream, p.start)
            stream.seek(first)
            body = stream.read(p.end - first)
        skipped = p.start - first  # bytes of an earlier piece: the beginning of a line that ends in this one
        stop = body.rfind(b"\n", skipped) + 1
        if not stop:
            return
        text = body[:stop].decode("utf-8", "replace")
        lines = re.split(LINE_BREAK, text)[:-1]
        n = len(lines)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p.path] * n), pa.array([p.mtime_ms] * n, pa.int64()), pa.array([p.fresh] * n), pa.array([p.start] * n, pa.int64()), pa.array(range(1, n + 1), pa.int64()), pa.array(lines, pa.string())],
            names=["path", "mtime_ms", "fresh", "start", "nth", "text"])

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


def _line_start(stream, at: int) -> int:
    """Where the line begins that goes on at ``at``: after the last line feed before it."""
    while at > 0:
        low = max(0, at - BACK)
        stream.seek(low)
        found = stream.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)

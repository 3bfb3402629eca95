"""Benchmark decontamination by an FM-index per shard of documents.

A shard is about a million words of the documents that a task reads. Its words
become numbers, those not in the benchmark all the same one, and only runs of
words whose consecutive pairs occur in the benchmark are indexed: a window can
lie nowhere else, and each shard's index stays small. The index is the
Burrows-Wheeler transform of the runs in a wavelet tree (a bit array with rank
per bit of the number), with every 16th text position kept. All windows are
searched backwards together, their occurrences located by walking to a kept
position, and the spans of a document merged.

The benchmark is broadcast in slices of at most ``SLICE_BYTES`` of text, so it
may have any size; hits of several slices are merged per document.

Defined results: null and empty texts have no words; items without words have
no window; items without id hit but are not listed; of items that share an id
each counts, the id is listed once; rows of documents that share an id are
judged each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmarts.session import fresh_dir

from .common import Folder, slices, small_batches, utf8

WINDOW = 13
SHARD_WORDS = 1 << 20
SLICE_BYTES = 4 << 20
KEPT = 16  # text positions per kept one
SHARE = 20  # contaminated: one word in so many is hit, at least
PAIRS = 1 << 22  # slots of the table of word pairs

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII digits and letters and of anything beyond ASCII, A-Z lower-cased."""
    return utf8(text).translate(_WORDS).split()


class Wavelet:
    """Rank over a sequence of numbers below 2^bits: per bit from the top, the bits in order of the higher ones."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in range(bits - 1, -1, -1):
            one = (sequence >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(sequence) - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[~one], sequence[one]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low = np.zeros_like(at)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            set_ = (symbols >> bit & 1).astype(bool)
            low, at = (np.where(set_, zeros + ones[x], x - ones[x]) for x in (low, at))
        return at - low

    def symbols(self, at: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        found = np.zeros_like(at)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            set_ = ones[at + 1] > ones[at]
            at = np.where(set_, zeros + ones[at], at - ones[at])
            found = found * 2 + set_
        return found


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the compared length."""
    n, k = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while True:
        later = np.zeros(n, np.int64)
        later[:max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[0], (np.diff(key[order]) > 0).astype(np.int64)]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class Index:
    """FM-index of a text of positive numbers; 0 is put at its end."""

    def __init__(self, text: np.ndarray, top: int):
        text = np.append(text, 0)
        order = suffix_order(text)
        self.wavelet = Wavelet(text[order - 1], max(1, int(top).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        kept = order % KEPT == 0
        self.kept, self.place = kept, np.cumsum(kept) - 1
        self.positions = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each phrase; a row of ``phrases`` ends at the array's right edge."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.first[-1])
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            symbol = phrases[live, phrases.shape[1] - 1 - step]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps to the left until a kept one."""
        out, at, back, live = np.zeros(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(live):
            here = self.kept[at]
            out[live[here]] = self.positions[self.place[at[here]]] + back
            live, at = live[~here], at[~here]
            symbol = self.wavelet.symbols(at)
            at, back = self.first[symbol] + self.wavelet.rank(symbol, at), back + 1
        return out


@dataclass
class Phrases:
    """The windows of some items."""

    number: dict[bytes, int]  # of words, from 2 on; 1 parts runs
    windows: np.ndarray  # one per row, at the right edge
    lengths: np.ndarray
    item_starts: np.ndarray  # items of window i: items[item_starts[i]:item_starts[i + 1]]
    items: np.ndarray  # places in ids
    ids: list[str | None]
    pairs: np.ndarray  # which hashed pairs of numbers occur in a window

    @staticmethod
    def of(items: list[tuple[int | None, str | None]], window: int) -> Phrases:
        number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[int]] = {}
        for place, (_, text) in enumerate(items):
            row = [number.setdefault(w, len(number) + 2) for w in words(text)]
            for i in range(max(1, len(row) - window + 1) if row else 0):
                own = found.setdefault(tuple(row[i:i + window]), [])
                if not own or own[-1] != place:
                    own.append(place)
        lengths = np.array([len(w) for w in found], np.int64)
        grid = np.zeros((len(found), window), np.int64)
        for i, w in enumerate(found):
            grid[i, window - len(w):] = w
        pairs = np.zeros(PAIRS, bool)
        for i in range(window - 1):
            has = grid[:, i] > 0
            pairs[_pair(grid[has, i], grid[has, i + 1])] = True
        return Phrases(number, grid, lengths, np.cumsum([0, *map(len, found.values())]), np.array([p for own in found.values() for p in own], np.int64), [None if k is None else str(k) for k, _ in items], pairs)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 7) % PAIRS


def hits(texts: list[str | None], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
    """For the documents of one shard: word counts, which words are hit (all documents in a row), items found."""
    get = phrases.number.get
    rows = [words(t) for t in texts]
    counts = np.array([len(r) for r in rows], np.int64)
    text = np.fromiter((get(w, 0) for r in rows for w in r), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(rows)), counts)
    hit, found = np.zeros(len(text), bool), [set() for _ in rows]
    if not len(phrases.lengths) or not len(text):
        return counts, hit, found
    # word i goes on with word i + 1 if they are of one document and may be so in a window
    goes = (text[:-1] > 0) & (text[1:] > 0) & (doc[:-1] == doc[1:])
    goes[goes] = phrases.pairs[_pair(text[:-1][goes], text[1:][goes])]
    run = np.cumsum(np.concatenate([[0], (~goes).astype(np.int64)]))
    wanted = (text > 0) & (np.bincount(run)[run] >= phrases.lengths.min())
    place = np.flatnonzero(wanted)
    if not len(place):
        return counts, hit, found
    # runs one after the other, parted by 1
    apart = np.concatenate([[0], np.cumsum(np.diff(run[place]) > 0)])
    indexed = np.ones(len(place) + apart[-1], np.int64)
    spot = np.arange(len(place)) + apart
    indexed[spot] = text[place]
    origin = np.zeros(len(indexed), np.int64)
    origin[spot] = place
    index = Index(indexed, len(phrases.number) + 1)
    low, high = index.search(phrases.windows, phrases.lengths)
    some = np.flatnonzero(high > low)
    sizes = (high - low)[some]
    window = np.repeat(some, sizes)
    suffix = np.repeat(low[some], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = origin[index.locate(suffix)]
    # spans of hit words, merged by counting which are open
    opened = np.zeros(len(text) + 1, np.int64)
    np.add.at(opened, start, 1)
    np.add.at(opened, start + phrases.lengths[window], -1)
    hit = np.cumsum(opened[:-1]) > 0
    n_windows = len(phrases.lengths)
    for pair in np.unique(doc[start] * n_windows + window).tolist():
        d, w = divmod(pair, n_windows)
        found[d].update(phrases.items[phrases.item_starts[w]:phrases.item_starts[w + 1]].tolist())
    return counts, hit, found


HITS = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
_hits = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): word count, hit spans in words, ids of items with occurring windows as sorted strings."""
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // slice_bytes))
    if parts == 1:
        shared = spark.sparkContext.broadcast(Phrases.of([tuple(r) for r in items.collect()], window))

        def every() -> Iterator[Phrases]:
            yield shared.value
    else:  # a slice is prepared at a time, and a task holds one
        folder = Folder(fresh_dir(spark, "phrases"))
        number = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
        for i in range(parts):
            out = folder.write(f"{i}")
            out.write(pickle.dumps(Phrases.of([tuple(r) for r in items.where(number == i).collect()], window)))
            out.close()

        def every() -> Iterator[Phrases]:
            for i in range(parts):
                with folder.read(f"{i}") as stream:
                    yield pickle.loads(stream.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 6 * shard_words):
            names: list[set[str]] = [set() for _ in rows]
            hit = None
            for phrases in every():
                counts, own, found = hits([t for _, t in rows], phrases)
                hit = own if hit is None else hit | own
                for known, places in zip(names, found, strict=True):
                    known.update(phrases.ids[x] for x in places)
            edges = np.concatenate([[0], np.cumsum(counts)])
            out = []
            for i, (key, _) in enumerate(rows):
                spans = []
                if names[i]:
                    turns = np.diff(np.concatenate([[0], hit[edges[i]:edges[i + 1]].astype(np.int8), [0]]))
                    spans = [{"start": a, "end": b} for a, b in zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(), strict=True)]
                out.append({"doc_id": key, "n_words": int(counts[i]), "spans": spans, "items": sorted(names[i] - {None})})
            yield pa.RecordBatch.from_pylist(out, schema=_hits)

    return texts.mapInArrow(run, HITS)


def report(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Per document: words, hit words, items, digest of the items' ids, whether it is contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    found = find(documents, benchmark, **how).withColumn("n_hit", n_hit)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans",
    )

"""Phrase collocations from one kind of window per language.

Every word opens a window of the longest phrase length: the word and its lead
columns, padded where its piece ends. Only whole windows are counted, in the
task that reads the text, and Spark's ROLLUP over (lang, w1, w2, ...) sums
them to all their beginnings: a phrase's count is the sum of the windows that
begin with it, so no phrase length is ever exploded by itself.

Before that, windows of two words, of three and so on up to the longest are
counted as hashes, and the slots of those that reach the least count are set in a
bitmap of a fixed size (``SLOTS`` bits each, so they may be broadcast at any size
of the input). A window is padded from the first pair, triple or longer one on
whose slot is unset: no phrase that holds such a one reaches the least count, so
all counts that matter stay whole. Hashes that share a slot only leave windows
longer than they need be. With the longest windows among them, what is counted
word by word is frequent phrases alone, however many of their beginnings go on
rarely.

Counted hashes go to the shuffle sorted, as differences in a few bytes each: a row
holds those of one range of hashes that one task met.

Defined results: null texts have no words; null languages are ``und``;
repeated rows count each time; an empty table, or one without frequent
phrases, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmarts.session import stored

from .common import small_batches, utf8

LONGEST = 4  # words of a phrase
LEAST = 30  # occurrences of a phrase
KEPT = 2000  # phrases of a language
SHADOW = (80, 100)  # a phrase goes if a longer one has so many of its occurrences
SCALE = 2_000_000
SLOTS = 1 << 26  # bits of a map of frequent windows: 8 MB
WINDOW_HASHES = 1 << 36  # windows are told apart by so many hashes while slots are counted; a multiple of any number of slots
RANGES = 1 << 13  # ranges of hashes, each a row of a task's counts
HELD = 4_000_000  # counts that a task holds at a time
STEP_BYTES = 6_000_000  # of text that are counted at a time
UNKNOWN = "und"
_BITS = 32768  # of one row of Spark's bitmaps
#: A-Z in lower case and every end of a piece as one byte that UTF-8 does not have.
_CLEAN = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words:
    """The words of some texts as places in their distinct words; 0 is the end of a piece."""

    def __init__(self, texts: list[str]):
        clean = b"\xff".join([b"", *map(utf8, texts), b""]).translate(_CLEAN).replace(b"\xff", b" \xff ")
        tokens = pc.split_pattern(pa.array([clean], pa.large_binary()), b" ").flatten()
        coded = tokens.filter(pc.greater(pc.binary_length(tokens), 0)).dictionary_encode()  # an end of a piece comes first
        self.known, self.at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)

    def hashes(self, lang: str) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.known.to_pylist()), np.uint64, len(self.known))


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One hash for two; multiplying wraps."""
    mixed = (first ^ (first >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + second
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _lead(column: np.ndarray, by: int = 1) -> np.ndarray:
    return np.concatenate([column[by:], np.zeros(min(by, len(column)), column.dtype)])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """(lang, texts) of at most ``STEP_BYTES`` characters together, one text at least."""
    held: dict[str, list[str]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if size and size + len(text) > STEP_BYTES:
                yield from held.items()
                held, size = {}, 0
            held.setdefault(lang, []).append(text)
            size += len(text)
    yield from held.items()


def _texts(documents: DataFrame, lang: str, text: str) -> DataFrame:
    small_batches(documents.sparkSession)
    body = F.col(text).cast("string")
    return documents.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), body.alias("text")).where("text IS NOT NULL")


class Opened:
    """The words of some texts with the windows that the bitmaps known so far leave open.

    ``here`` is the word at each place, 0 where it is rare; ``goes[i]`` says of
    each place whether the window of ``i + 2`` words there may be frequent.
    """

    def __init__(self, lang: str, bodies: list[str], maps: list[np.ndarray]):
        words = Words(bodies)
        self.known, self.at, self.single = words.known, words.at, words.hashes(lang)
        common = _set(maps[0], self.single) if maps else np.ones(len(self.single), bool)
        common[0] = False
        self.here = np.where(common[self.at], self.at, 0)
        self.goes: list[np.ndarray] = []
        for i, bits in enumerate(maps):
            places, hashes = self.windows(i + 2)
            goes = np.zeros(len(self.here), bool)
            goes[places] = _set(bits, hashes)
            self.goes.append(goes)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of so many words whose shorter ones are all open."""
        if length == 2:
            places = np.flatnonzero((self.here > 0) & (_lead(self.here) > 0))
        else:
            places = np.flatnonzero(self.goes[length - 3] & _lead(self.goes[length - 3]))
        hashes = self.single[self.here[places]]
        for i in range(1, length):
            hashes = _paired(hashes, self.single[self.here[places + i]])
        return places, hashes


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order with the sums of their counts."""
    most = (1 << 64) // WINDOW_HASHES - 1
    key = np.sort(h * np.uint64(most + 1) + np.minimum(n, most).astype(np.uint64))  # one sort of numbers; a count of ``most`` or more is frequent anyway
    h = key // np.uint64(most + 1)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], np.add.reduceat((key % np.uint64(most + 1)).astype(np.int64), first) if len(h) else n


def _variable(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in as many bytes of seven bits as they need, the last of each under 128; how many bytes each has."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, max(int(values.max(initial=0)).bit_length(), 1), 7):
        size += values >= np.uint64(1 << bits)
    starts = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        has = size > i
        out[starts[has] + i] = (values[has] >> np.uint64(7 * i)) & np.uint64(127) | np.where(size[has] > i + 1, 128, 0).astype(np.uint64)
    return out, size


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``_variable``, and where each one's bytes begin."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    size, values = ends - starts, np.zeros(len(ends), np.uint64)
    for i in range(int(size.max(initial=0))):
        has = size > i
        values[has] |= (data[starts[has] + i] & 127).astype(np.uint64) << np.uint64(7 * i)
    return values, starts


def packed(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(range, rows, counts): of each range of hashes the steps from one hash to the next, doubled, and odd where the count is not one; then those counts."""
    width = WINDOW_HASHES // RANGES
    own = (h // np.uint64(width)).astype(np.int64)
    ranges, first, rows = np.unique(own, return_index=True, return_counts=True)
    steps = np.diff(h, prepend=np.uint64(0))
    steps[first] = h[first] % np.uint64(width)
    many = n > 1
    of = np.concatenate([own, own[many]])
    values = np.concatenate([steps * np.uint64(2) + many, n[many].astype(np.uint64)])[np.argsort(of, kind="stable")]
    data, size = _variable(values)
    edges = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(np.bincount(of, minlength=RANGES)[ranges])])]
    body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ranges), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), pa.array(rows.astype(np.int32)), body.cast(pa.binary())], names=["range", "rows", "counts"])


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of rows of ``packed``."""
    ranges, rows = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    body = batch.column(2).cast(pa.large_binary())
    edges = np.frombuffer(body.buffers()[1], np.int64)[body.offset:body.offset + len(body) + 1]
    values, starts = _numbers(np.frombuffer(body.buffers()[2], np.uint8)[edges[0]:edges[-1]])
    begin = np.searchsorted(starts, edges[:-1] - edges[0])  # of each row among the numbers
    before = np.cumsum(rows) - rows
    place = np.arange(int(rows.sum())) + np.repeat(begin - before, rows)
    steps = values[place]
    many = (steps & np.uint64(1)) > 0
    total = np.cumsum(steps >> np.uint64(1))  # wraps, as does what is taken off
    base = (total - (steps >> np.uint64(1)))[before] if len(rows) else total
    h = total + np.repeat((ranges * (WINDOW_HASHES // RANGES)).astype(np.uint64) - base, rows)
    n = np.ones(len(h), np.int64)
    counts = np.ones(len(values), bool)
    counts[place] = False
    n[many] = values[counts].astype(np.int64)
    return h, n


def frequent_slots(texts: DataFrame, least: int, length: int, maps: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """The bitmap, as bytes, of the slots of windows of ``length`` words that occur ``least`` times, and maybe of others; the one of pairs also has the words."""
    shared = texts.sparkSession.sparkContext.broadcast(maps)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for lang, bodies in _steps(batches):
            text = Opened(lang, bodies, shared.value)
            hashes = text.windows(length)[1]
            n = np.ones(len(hashes), np.int64)
            if length == 2:
                hashes, n = np.concatenate([text.single[1:], hashes]), np.concatenate([np.bincount(text.at, minlength=len(text.single))[1:], n])
            held.append((hashes & np.uint64(WINDOW_HASHES - 1), n))
            size += len(hashes)
            if size > HELD:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield packed(*held[0])
                    held, size = [], 0
        if held:
            yield packed(*_summed(*map(np.concatenate, zip(*held))))

    def frequent(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h[n >= least].astype(np.int64))], names=["h"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, limit = [], 0, -1, HELD
        for batch in batches:
            if batch.num_rows:
                held.append(unpacked(batch))
                size, last = size + len(held[-1][0]), batch.column(0)[-1].as_py()
            if size > limit:  # ranges before the last one are whole; of that one no more than its hashes are held
                h, n = _summed(*map(np.concatenate, zip(*held)))
                whole = np.searchsorted(h, np.uint64(last * (WINDOW_HASHES // RANGES)))
                yield frequent(h[:whole], n[:whole])
                held, size = [(h[whole:], n[whole:])], len(h) - whole
                limit = HELD + 2 * size
        if held:
            yield frequent(*_summed(*map(np.concatenate, zip(*held))))

    counts = texts.mapInArrow(count, "range int, rows int, counts binary").repartition("range").sortWithinPartitions("range")
    slot = F.pmod(F.col("h"), F.lit(slots)) + 1
    rows = counts.mapInArrow(total, "h long").groupBy(F.bitmap_bucket_number(slot).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    found = np.zeros((slots // _BITS, _BITS // 8), np.uint8)
    for r in rows.collect():  # slots / 8 bytes at most
        found[r.row - 1] = np.frombuffer(r.bits, np.uint8)
    return found.reshape(-1)


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.int64) % (len(bits) * 8)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _counted(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of a table of places, and how often each occurs."""
    if not len(grid) or not grid.shape[1]:
        return grid[:, :min(1, grid.shape[1])], np.array([grid.shape[1]] if grid.shape[1] else [], np.int64)
    words, ranks = np.unique(grid, return_inverse=True)
    ranks, many = ranks.reshape(grid.shape), len(words)
    if many ** len(grid) >= 1 << 63:  # the last row against the distinct columns above it
        above, place = np.unique(grid[:-1], axis=1, return_inverse=True)
        key, n = np.unique(place.reshape(-1) * many + ranks[-1], return_counts=True)
        return np.concatenate([above[:, key // many], words[key % many][None]]), n
    key = ranks[0]
    for row in ranks[1:]:
        key = key * many + row
    key, n = np.unique(key, return_counts=True)
    return np.stack([words[key // many ** i % many] for i in range(len(grid) - 1, -1, -1)]), n


def windows(texts: DataFrame, maps: list[np.ndarray], longest: int = LONGEST) -> DataFrame:
    """(lang, w1 ... wn, n): padded windows as counted by each task; '' is padding, and a window of it alone stands for a rare word."""
    shared = texts.sparkSession.sparkContext.broadcast(maps)
    names = [f"w{i}" for i in range(1, longest + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, bodies in _steps(batches):
            text = Opened(lang, bodies, shared.value)
            real = text.at > 0
            if not real.any():
                continue
            columns, alive = [text.here], text.here > 0
            for i in range(1, longest):  # the last word of each window so far must go on to the next
                for j, goes in enumerate(text.goes[:i]):
                    alive = alive & _lead(goes, i - 1 - j)
                columns.append(np.where(alive, _lead(text.here, i), 0))
            grid = np.stack([c[real] for c in columns])
            lengths = (grid > 0).sum(axis=0)
            found, counts = [], []
            for length in range(longest + 1):  # windows of so many words
                distinct, n = _counted(grid[:length, lengths == length])
                found.append(np.concatenate([distinct, np.zeros((longest - length, len(n)), np.int64)]))
                counts.append(n)
            vocabulary = pa.concat_arrays([pa.array([b""], pa.large_binary()), text.known[1:]]).cast(pa.binary()).cast(pa.string())
            spelled = [vocabulary.take(pa.array(c)) for c in np.concatenate(found, axis=1)]
            n = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *spelled, pa.array(n)], names=["lang", *names, "n"])

    return texts.mapInArrow(run, ", ".join(["lang string", *(f"{c} string" for c in names), "n long"]))


def phrase_counts(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, lang: str = "lang", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(lang, words, phrase, f) of every phrase of up to ``longest`` words that occurs ``least`` times, and per language a row of no words: all occurrences of words."""
    texts = _texts(documents, lang, text)
    maps: list[np.ndarray] = []
    for length in range(2, longest + 1):
        maps.append(frequent_slots(texts, least, length, maps, slots))
    counted = windows(texts, maps, longest)
    names = [f"w{i}" for i in range(1, longest + 1)]
    once = counted.groupBy("lang", *names).agg(F.sum("n").alias("n"))  # tasks have many windows in common: fewer rows to roll up
    sums = once.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    words = F.lit(longest) - F.length(F.conv(F.col("level"), 10, 2)).cast("int") * (F.col("level") > 0).cast("int")
    last = F.coalesce(*[F.col(c) for c in reversed(names)])  # the last word that is not rolled up
    kept = sums.withColumn("words", words).where("lang IS NOT NULL").where((F.col("words") == 0) | ((F.col("f") >= least) & (last != "")))
    return kept.select("lang", "words", F.concat_ws(" ", *names).alias("phrase"), "f")


def _part(first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def collocations(documents: DataFrame, least: int = LEAST, kept: int | None = KEPT, longest: int = LONGEST, shadow: tuple[int, int] = SHADOW, lang: str = "lang", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, k): each language's best phrases (all, if ``kept`` is None); ``k`` is the cut that counts."""
    counts = stored(phrase_counts(documents, least, longest, lang, text, slots), "phrases")
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("words > 0").select("lang", "phrase", "words", "f")
    phrases = known.where("words > 1").withColumn("w", F.split("phrase", " "))

    def wide(name: str, digits: int = 20) -> Column:
        return F.col(name).cast(f"decimal({digits},0)")

    # the best longer phrase around each
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    around = phrases.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    share, of = shadow
    apart = phrases.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * of < wide("f") * share))
    # every cut with the counts of its parts, the worst one counts
    cuts = apart.select("lang", "phrase", "words", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left_part"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right_part"))
    for part, name in (("left_part", "l"), ("right_part", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    cuts = cuts.withColumn("score", F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    worst = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    placed = worst.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    best = placed if kept is None else placed.where(F.col("rank") <= kept)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("k").cast("long").alias("k"))


def report(documents: DataFrame) -> DataFrame:
    return collocations(documents).drop("k")

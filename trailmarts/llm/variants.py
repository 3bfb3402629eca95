"""Spelling variants, found with grams of variable length.

Words are counted over whole texts first. The gram dictionary holds every gram
of ``SHORT`` letters, and longer ones up to ``LONG`` where they occur often: a
gram is extended only if more than ``PRUNE`` places have it and if its share of
all places is above 1 / ``ROOM``, so the dictionary has fewer than ``ROOM``
longer grams of each length whatever the input (its proven bound; it is
broadcast). A padded word is decomposed into the longest gram at each place,
without those inside an earlier one.

Each word has its own bound: a gram depends on its letters, on the letter after
it if the dictionary has longer grams that begin with it, and on as many letters
before it as a gram that contains it could begin earlier. One edit therefore
affects at most the grams whose span of letters holds one place; the largest
such number over the word's places is its affected-gram bound. Two near words
share at least the grams of either that are not affected, so of a word with g
grams and a bound of a the lists of its a + 1 rarest grams are enough: only
those are merged. Lists are searched by length and place, and each candidate is
verified. Lists of more than ``LIST`` words are cut into chunks that meet
pairwise in tasks of their own.

Defined results: null and empty texts have no words; null ids count as empty in
the hash; rows that share an id and a text count each time; very long words
are words like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmarts.session import stored

from .common import slices, small_batches, utf8

LEAST_LETTERS = 7
LEAST_COUNT = 2
ERROR_RATE = 31  # of the contract's deletions
RATIO = 10  # a form is so many times as frequent
SHORT, LONG = 3, 5  # letters of a gram
PAD = 3  # at both ends: leaves a gram unaffected by any one edit
PRUNE = 64
ROOM = 1 << 18
LIST = 20_000  # words of one list that meet in a task
GROUP = 60_000  # rows of a task's call, about
PAIRS = 1 << 19  # candidates compared at a time
WIDE = 40  # letters of words that are compared as a matrix
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def with_errors(doc_id: object, run: str, rate: int = ERROR_RATE) -> str:
    """``run`` without one letter where the hash of id and run says so."""
    h = zlib.crc32(utf8(f"{'' if doc_id is None else doc_id}:{run}"))
    if h % rate:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over all texts; A-Z in lower case."""
    small_batches(documents.sparkSession)
    runs = re.compile(RUN.pattern[:-1] + f"{{{least_letters},}}")  # shorter runs give no word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            total: Counter[str] = Counter()
            for key, body in part:
                for w, n in Counter(runs.findall(utf8(body).lower().decode("utf-8", "surrogatepass"))).items():
                    total[with_errors(key, w)] += n
            words = [w for w in total if len(w) >= least_letters]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _numbers(grams: list[str]) -> np.ndarray:
    """Each gram as one number: its length and its letters, all of Latin-1."""
    return np.array([len(g) << 8 * LONG | int.from_bytes(g.encode("latin-1"), "big") for g in grams], np.int64)


class Lookup:
    """A map from numbers of grams to values, asked for many at once."""

    def __init__(self, of: dict[str, int], default: int = 0):
        keys = _numbers(list(of))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1) << 62)
        self.values = np.append(np.array(list(of.values()), np.int64)[order], default)
        self.default = default

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], self.default)


class Grams:
    """The dictionary, made of the longer grams and the short ones that are frequent, with their counts."""

    def __init__(self, often: dict[str, int]):
        self.often = often
        longer = [g for g in often if len(g) > SHORT]
        left, before = dict(often), {}
        for g in longer:
            left[g[:-1]] -= often[g]
            for at in range(1, len(g) - SHORT + 1):
                for end in range(at + SHORT, len(g) + 1):
                    before[g[at:end]] = max(at, before.get(g[at:end], 0))
        self.known = Lookup(dict.fromkeys(longer, 1))
        self.extended = Lookup({g[:-1]: 1 for g in longer})  # beginnings of longer grams
        self.before = Lookup(before)  # how much earlier a gram that contains this one may begin
        self.left = Lookup(left)  # places where no longer gram stands

    def probes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the lists that are merged for each word: (word's place, the list's number, gram's place, whether the word has it again)."""
        padded = [b"^" * PAD + w.encode("latin-1") + b"$" * PAD for w in words]
        letters = np.frombuffer(b"".join([*padded, bytes(LONG)]), np.uint8).astype(np.int64)
        sizes = np.array([len(p) for p in padded], np.int64)
        stop = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(word))
        room = stop[word] - place  # letters up to the word's end
        # the longest gram at each place
        number = sum(letters[i:i + len(place)] << 8 * (SHORT - 1 - i) for i in range(SHORT))
        key, length = number | SHORT << 8 * LONG, np.full(len(place), SHORT)
        for q in range(SHORT + 1, LONG + 1):
            number = number << 8 | letters[q - 1:q - 1 + len(place)]
            longer = number | q << 8 * LONG
            goes = (length == q - 1) & (room >= q) & (self.known.get(longer) > 0)
            key, length = np.where(goes, longer, key), length + goes
        reached = np.where(room >= SHORT, place + length, 0)
        kept = reached > 0
        for back in range(1, LONG - SHORT + 1):  # not inside an earlier one
            kept[back:] &= (reached[back:] > reached[:-back]) | (word[back:] != word[:-back])
        at = np.flatnonzero(kept)
        key, word, begin = key[at], word[at], stop[word[at]] - sizes[word[at]]
        # the most grams that one edit affects: spans of letters, counted at each letter
        first = np.maximum(at - self.before.get(key), begin)
        end = np.minimum(reached[at] + self.extended.get(key), stop[word])
        over = np.cumsum(np.bincount(first, minlength=len(place) + 1) - np.bincount(end, minlength=len(place) + 1))[:-1]
        real = np.ones(len(place), bool)
        for i in range(PAD):
            real[stop - 1 - i] = real[stop - sizes + i] = False
        most = np.maximum.reduceat(np.where(real, over, 0), stop - sizes)
        # which of the word's occurrences of the gram it is, then the rarest lists
        order = np.lexsort([at, key, self.left.get(key), word])
        at, key, word, begin = at[order], key[order], word[order], begin[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (word[1:] != word[:-1])])
        run = np.cumsum(fresh) - 1
        nth = np.arange(len(at)) - np.flatnonzero(fresh)[run]
        again = np.bincount(run)[run] > 1
        opens = np.concatenate([[True], word[1:] != word[:-1]])
        rank = np.arange(len(at)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
        merged = rank <= most[word]
        return word[merged], (nth[merged] << 8 * LONG + 3) | key[merged], (at - begin)[merged], again[merged]


def dictionary(words: DataFrame, room: int = ROOM, prune: int = PRUNE) -> Grams:
    """Grams of ``words`` pruned by frequency; fewer than ``room`` of each length come to the driver."""
    padded = F.concat(F.lit("^" * PAD), "word", F.lit("$" * PAD))

    def of_length(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("word") + (2 * PAD - q + 1)), lambda i: F.substr(padded, i, F.lit(q)))

    grams = words.select(F.explode(F.concat(*(of_length(q) for q in range(SHORT, LONG + 1)))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    grams = stored(grams.where(F.col("f") > 1).withColumn("q", F.length("gram")), "grams")
    places = words.agg(F.sum(F.length("word").cast("long")), F.count(F.lit(1))).first()
    bounds = {q: ((places[0] or 0) + places[1] * (2 * PAD - q + 1)) / room for q in range(SHORT, LONG + 1)}
    wanted = F.lit(False)
    for q, bound in bounds.items():
        wanted = wanted | ((F.col("q") == q) & (F.col("f") > bound))
    known = {r.gram: r.f for r in grams.where(wanted).collect()}  # fewer than ``room`` of each length
    often = {g: f for g, f in known.items() if len(g) == SHORT}
    for q in range(SHORT + 1, LONG + 1):
        often |= {g: f for g, f in known.items() if len(g) == q and often.get(g[:-1], 0) > prune}
    return Grams(often)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


class Verifier:
    """Compares words by their places; those of ordinary length as rows of a matrix."""

    def __init__(self, words: list[str]):
        self.words = words
        self.letters = np.array([len(w) for w in words], np.int64)
        wide = int(min(WIDE, self.letters.max(initial=1))) + 1
        self.matrix = np.frombuffer(b"".join(w.encode("latin-1")[:wide].ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are one edit apart; ``a`` is no longer than ``b``, and ``b`` longer by one at most."""
        found = np.zeros(len(a), bool)
        fits = self.letters[b] < self.matrix.shape[1]
        for i in np.flatnonzero(~fits).tolist():
            found[i] = one_edit(self.words[a[i]], self.words[b[i]])
        same = np.flatnonzero(fits & (self.letters[a] == self.letters[b]))
        found[same] = (self.matrix[a[same]] != self.matrix[b[same]]).sum(1) == 1
        more = np.flatnonzero(fits & (self.letters[a] < self.letters[b]))
        x, y = self.matrix[a[more]], self.matrix[b[more]]
        first = (x != y).argmax(1)  # the first place that differs
        apart = x[:, :-1] != y[:, 1:]
        last = np.where(apart.any(1), apart.shape[1] - 1 - apart[:, ::-1].argmax(1), -1)
        found[more] = last < first
        return found


def _merged(part: pa.Table) -> pa.Table:
    """Near pairs of a task's lists: a list is one gram of one cell of chunks."""
    cell = np.unique(np.stack([part.column(c).to_numpy() for c in ("g", "i", "j")]), axis=1, return_inverse=True)[1].astype(np.int64).reshape(-1)
    coded = part.column("word").combine_chunks().dictionary_encode()
    words, places = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    check = Verifier(words.to_pylist())
    letters, at = check.letters[places], part.column("at").to_numpy().astype(np.int64)
    again, asks = (part.column(c).to_numpy(zero_copy_only=False) for c in ("again", "asks"))
    both = part.column("i").to_numpy() == part.column("j").to_numpy()
    # one number for list, length and place: neighbours in it are the candidates
    span = int(letters.max(initial=0)) + 2 * PAD + 2
    long_span = int(letters.max(initial=0)) + 2
    block = (cell * long_span + letters) * span + at
    order = np.argsort(block, kind="stable")
    block, cell, letters, at, again, asks, places, both = (v[order] for v in (block, cell, letters, at, again, asks, places, both))
    base = cell * long_span + letters
    starts, ends, rows = [], [], []
    every = np.arange(len(block))
    for more in (0, 1):  # words of the same length, words longer by one
        low = np.where(again, (base + more) * span, (base + more) * span + at)
        high = np.where(again, (base + more) * span + span - 1, (base + more) * span + at + more)
        starts.append(np.searchsorted(block, low, "left"))
        ends.append(np.searchsorted(block, high, "right"))
        rows.append(every)
    # a gram that a word has once may stand elsewhere in a word that has it again
    repeated = np.flatnonzero(again)
    extra_a, extra_b = [], []
    for r in repeated.tolist():
        for more in (0, -1):
            a, b = np.searchsorted(block, [(base[r] + more) * span, (base[r] + more + 1) * span])
            extra_a.append(np.arange(a, b))
            extra_b.append(np.full(b - a, r))
    found = []

    def take(a: np.ndarray, b: np.ndarray) -> None:
        wanted = (places[a] != places[b]) & (both[a] | (asks[a] != asks[b]))
        a, b = places[a[wanted]], places[b[wanted]]
        swap = check.letters[a] > check.letters[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        near = check.near(a, b)
        a, b = a[near], b[near]
        found.append(np.unique(np.minimum(a, b) * len(words) + np.maximum(a, b)))

    for start, end, row in zip(starts, ends, rows, strict=True):
        n = end - start
        edges = np.concatenate([[0], np.cumsum(n)])
        i = 0
        while i < len(row):  # whole rows, about PAIRS candidates together
            k = max(i + 1, int(np.searchsorted(edges, edges[i] + PAIRS, "right")) - 1)
            of = np.repeat(row[i:k], n[i:k])
            take(of, np.arange(edges[k] - edges[i]) - np.repeat(edges[i:k] - edges[i], n[i:k]) + np.repeat(start[i:k], n[i:k]))
            i = k
    if extra_a:
        a, b = np.concatenate(extra_a), np.concatenate(extra_b)
        for i in range(0, len(a), PAIRS):
            take(a[i:i + PAIRS], b[i:i + PAIRS])
    pairs = np.unique(np.concatenate([*found, np.empty(0, np.int64)]))
    a, b = (words.take(pa.array(x)) for x in (pairs // max(1, len(words)), pairs % max(1, len(words))))
    return pa.table({"a": a, "b": b})


def near_words(words: DataFrame, grams: Grams, list_rows: int = LIST, group: int = GROUP) -> DataFrame:
    """(a, b): all pairs of near words, each once."""
    shared = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                word, g, at, again = shared.value.probes(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(at, pa.int32()), pa.array(again), batch.column(0).take(pa.array(word))], names=["g", "at", "again", "word"])

    listed = stored(words.select("word").mapInArrow(run, "g long, at int, again boolean, word string"), "gram-lists")
    sizes = stored(listed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "gram-sizes")
    groups = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // group))
    sizes = sizes.withColumn("chunks", F.ceil(F.col("n") / list_rows).cast("int"))
    member = listed.join(sizes, "g").withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    cells = F.sequence(F.lit(0), F.col("chunks") - 1)
    of_chunk = F.transform(cells, lambda c: F.struct(F.least(c, "chunk").alias("i"), F.greatest(c, "chunk").alias("j"), (c < F.col("chunk")).alias("asks")))
    dealt = member.select("g", "n", "chunks", "at", "again", "word", F.explode(of_chunk).alias("cell")).select("g", "n", "chunks", "cell.*", "at", "again", "word")
    room = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("g"), F.lit(groups))).otherwise(F.xxhash64("g", "i", "j"))
    return dealt.withColumn("room", room).groupBy("room").applyInArrow(_merged, "a string, b string").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of each word end. A form is more frequent, so there is no cycle; each step doubles what is followed."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        after = stored(now.join(up, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, room: int = ROOM, prune: int = PRUNE, list_rows: int = LIST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n), whose words are distinct."""
    pairs = stored(near_words(words, dictionary(words, room, prune), list_rows), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(counts, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left").withColumn("near_n", -F.col("best.less"))
    has = F.col("near_n") >= ratio * F.col("n")
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "forms")
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(documents: DataFrame) -> DataFrame:
    return variants(stored(word_counts(documents), "words"))

"""Language by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, runs of anything but letters become one space, and its
n-grams of one to three characters are hashed. Training counts n-grams per language in
tasks and sums the counts with Spark, over at most about ``sample`` labelled
rows: rows whose hash of the id falls below the share that makes so many.
The matrix of log-probabilities (buckets x languages) is broadcast, and batches
of texts are scored at once in numpy.

Defined results: a text that is null or has no letter is ``und`` with score 0,
as is any text when there is nothing to learn from; rows without language are
not learnt; the score is the posterior of the language, all languages equally
likely before; equal posteriors go to the language first in binary order; rows
that share an id are scored each on its own; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, slices, small_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE = 20_000  # rows that are learnt from, about
STEP_CHARS = 1_000_000
UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of every n-gram of the texts, order by order."""
    plain = [" " + _NO_LETTERS.sub(" ", t.lower()).strip() + " " for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    rows = np.repeat(np.arange(len(plain)), [len(p) for p in plain])
    for n in ORDERS:
        if len(codes) < n:
            return
        h = np.full(len(codes) - n + 1, n, np.uint32)
        for j in range(n):
            h = (h ^ codes[j:len(codes) - n + 1 + j]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        inside = rows[:len(h)] == rows[n - 1:]
        yield rows[:len(h)][inside], (h % np.uint32(BUCKETS))[inside].astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(c.isalpha() for c in text[:200]) or any(c.isalpha() for c in text))


@dataclass
class Model:
    """Log-probabilities by language: those of the buckets that the sample has, and the common one of all others."""

    languages: list[str]
    seen: list[tuple[np.ndarray, np.ndarray]]  # buckets and their values
    unseen: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.languages or not known:
            return out
        total = np.zeros((len(known), len(self.languages)))
        found = list(grams([texts[i] for i in known]))
        for k, (at, values) in enumerate(self.seen):  # a language's row of the matrix at a time
            log_p = np.full(BUCKETS, self.unseen[k])
            log_p[at] = values
            for rows, buckets in found:
                total[:, k] += np.bincount(rows, log_p.take(buckets), len(known))
        odds = np.exp(total - total.max(1, keepdims=True))
        best = odds.argmax(1)
        score = odds[np.arange(len(known)), best] / odds.sum(1)
        for i, b, s in zip(known, best, score, strict=True):
            out[i] = (self.languages[b], float(s))
        return out


def train(documents: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, smoothing: float = 0.5) -> Model:
    """Learn from rows with a language for which ``learn`` (of ``doc_id``) holds."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & learn)
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    taken = rows.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part in slices(batches, STEP_CHARS):
            by_lang: dict[str, list[str]] = {}
            for _, body, language in part:
                if has_letter(body):
                    by_lang.setdefault(language, []).append(body)
            for language, bodies in by_lang.items():
                own = counts.setdefault(language, np.zeros(BUCKETS, np.int64))
                for _, buckets in grams(bodies):
                    own += np.bincount(buckets, minlength=BUCKETS)
        for language, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at)), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])

    counts = taken.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # the buckets of the sample's texts by language, however many languages it has
    table = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("found")).orderBy("lang").toArrow()
    seen, unseen = [], []
    for found in table.column("found"):
        n = found.values.field("n").to_numpy()
        total = n.sum() + smoothing * BUCKETS
        seen.append((found.values.field("bucket").to_numpy().astype(np.uint16), np.log((n + smoothing) / total)))
        unseen.append(np.log(smoothing / total))
    return Model(table.column("lang").to_pylist(), seen, np.array(unseen))


def predicted(rows: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, STEP_CHARS):
            found = shared.value.predict([r[1] for r in part])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    small_batches(rows.sparkSession)
    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(documents: DataFrame, folds: int = 3) -> DataFrame:
    """Language of every document by a model that has not seen fold 1."""
    model = train(documents, crc_fold("doc_id", folds) != 1)
    return predicted(documents, model).select("doc_id", (crc_fold("doc_id", folds) == 1).alias("held_out"), "lang_pred", "score")

"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings of four and five letters
(insults take endings), each hashed once per text. The machine scores
w0 + sum(w) + pairwise products of the terms' factors, so a pair of terms can
weigh more or less than both alone. It is fitted in numpy on at most
``sample`` labelled rows, taken by the order of a hash of their id over all
labelled rows; of the terms, those that tell the labels apart best are learnt.
The broadcast model has at most ``TERMS`` terms.

Defined results: a null or empty text has no terms and the score of the
intercept; labels that are null are not learnt, and of several labels of a
document 1 holds; rows that share an id are scored each on its own; without
labels every score is that of a prior of one half to two rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, small_batches

BUCKETS = 1 << 28
SAMPLE = 16_000  # labelled rows that the machine is fitted on at most
TERMS = 4096
FACTORS = 4
BATCH, RATE = 64, 0.3
STEPS = 6000  # batches learnt from; fewer rows are gone over more often
LEAST_ROWS = 3  # rows of the sample a term must occur in


def terms(text: Column) -> Column:
    """Distinct hashed terms of a text."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")

    def hashed(kind: str, part) -> Column:
        return F.transform(kept, lambda w: F.pmod(F.xxhash64(F.lit(kind), part(w)), F.lit(BUCKETS)).cast("int"))

    kept = F.array_distinct(F.filter(words, lambda w: w != ""))
    return F.array_distinct(F.concat(hashed("word", lambda w: w), hashed("four", lambda w: F.left(w, F.lit(4))), hashed("five", lambda w: F.left(w, F.lit(5)))))


@dataclass
class Machine:
    terms: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Probability per row; row i has the hashes from offsets[i] to before offsets[i + 1]."""
        n = len(offsets) - 1
        out = np.full(n, self.bias)
        if len(self.terms) and len(hashes):
            at = np.searchsorted(self.terms, hashes)
            at[at == len(self.terms)] = 0
            known = self.terms[at] == hashes
            rows, at = np.repeat(np.arange(n), np.diff(offsets))[known], at[known]
            out += np.bincount(rows, self.weights[at], n)
            for f in range(self.factors.shape[1]):
                v = self.factors[at, f]
                out += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(offsets: np.ndarray, hashes: np.ndarray, labels: np.ndarray, seed: int = 7) -> Machine:
    """Choose the terms by how far their share of toxic rows is from chance, then learn by gradient steps over small batches.

    Row i has the hashes from offsets[i] to before offsets[i + 1]. Toxic rows
    are few, so each counts as the square root of the odds against it.
    """
    n, positive = len(labels), float(labels.sum())
    weight = max(1.0, np.sqrt((n - positive + 0.5) / (positive + 0.5))) if positive else 1.0
    bias = float(np.log(weight * (positive + 0.5) / (n - positive + 0.5)))
    if not len(hashes) or not 0 < positive < n:
        return Machine(np.empty(0, np.int64), bias, np.empty(0), np.empty((0, FACTORS)))
    of_row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    ids, seen = np.unique(hashes, return_counts=True)
    toxic, counts = np.unique(hashes[labels[of_row] > 0], return_counts=True)
    hit = np.zeros(len(ids))
    hit[np.searchsorted(ids, toxic)] = counts
    share = positive / n
    gain = (hit - seen * share) ** 2 / (seen * share * (1 - share))
    gain[seen < LEAST_ROWS] = 0
    best = np.argsort(-gain, kind="stable")[:TERMS]
    chosen = np.sort(ids[best[gain[best] > 6.6]]).astype(np.int64)  # chi-square beyond the 1 % level
    if not len(chosen):
        return Machine(chosen, bias, np.empty(0), np.empty((0, FACTORS)))
    parts = []
    for at in range(0, len(hashes), 1 << 20):  # terms that were not chosen go
        place = np.minimum(np.searchsorted(chosen, hashes[at:at + (1 << 20)]), len(chosen) - 1)
        known = np.flatnonzero(chosen[place] == hashes[at:at + (1 << 20)])
        parts.append((place[known].astype(np.int32), of_row[at + known]))
    local, of_row = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts = np.searchsorted(of_row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), FACTORS))
    gw, gv, gb = np.full(len(chosen), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(-(-STEPS * BATCH // n)):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            batch = order[at:at + BATCH]
            sizes = starts[batch + 1] - starts[batch]
            where = np.repeat(starts[batch], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            t, r = local[where], np.repeat(np.arange(len(batch)), sizes)
            sums = np.zeros((len(batch), FACTORS))
            np.add.at(sums, r, v[t])
            squares = np.bincount(r, (v[t] ** 2).sum(1), len(batch))
            raw = bias + np.bincount(r, w[t], len(batch)) + 0.5 * ((sums ** 2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]) * np.where(labels[batch] > 0, weight, 1.0)
            # AdaGrad with weight decay, on the terms of this batch
            gb += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(gb)
            used, back = np.unique(t, return_inverse=True)
            dw = np.bincount(back, error[r], len(used)) + 1e-3 * w[used]
            gw[used] += dw ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, back, error[r, None] * (sums[r] - v[t]))
            dv += 1e-2 * v[used]
            gv[used] += dv ** 2
            v[used] -= RATE / 5 * dv / np.sqrt(gv[used])
    return Machine(chosen, bias, w, v)


def train(documents: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit on labelled rows for which ``learn`` (of ``doc_id``) holds, ``sample`` at most."""
    small_batches(documents.sparkSession)
    marked = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(learn).groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # the broadcast side has at most ``sample`` rows of two numbers
    taken = texts.join(F.broadcast(marked), "doc_id").select("doc_id", "label", terms(F.col("text")).alias("terms"))
    found = taken.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("terms").alias("terms")).orderBy("doc_id")
    table = found.toArrow().combine_chunks()
    lists = table.column("terms").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    return fit(lists.offsets.to_numpy(), lists.values.to_numpy(), table.column("label").to_numpy().astype(np.float64))


def scored(texts: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of a table (doc_id, terms)."""
    shared = texts.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            hashes = lists.values.to_numpy()[offsets[0]:offsets[-1]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(offsets - offsets[0], hashes))], names=["doc_id", "score"])

    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, "doc_id long, score double")


def report(documents: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Score of every document by a machine that has not seen the labels of fold 0."""
    machine = train(documents, labels, crc_fold("doc_id", folds) != 0)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), terms(F.col("text")).alias("terms"))
    out = scored(texts, machine)
    return out.select("doc_id", (crc_fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Toxicity by follow-the-regularised-leader logistic regression over hashed word n-grams.

Features are the words (letters and digits, A-Z in lower case) of a text, their pairs, and the pairs with one word between, each hashed to one of
2**``BITS`` coordinates; a text has a feature or has it not, whatever its length.  Every coordinate has its own learning rate, and
coordinates whose gradients don't add up to ``L1`` stay exactly 0, so that a few hundred weights are left, which every task gets.
One task fits them on a bounded sample - ``PER_CLASS`` labelled rows a class, in the order of a hash, ``EPOCHS`` times or until ``SEEN`` rows
were seen - as a stream: it holds the coordinates and one batch.  Rows are weighted to the labels' own shares, toxic ones
``BOOST`` times as much, and the weights start from those shares' odds.  Scoring shuffles nothing.

Null and empty texts get the intercept's score.  Without rows of both labels, every score is the share of
label 1 (0.5 without any).  Repeated rows get equal scores; a null doc_id is held out.  Extra columns are ignored.  An empty table
gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, short_batches
from .labelled import sample
from .words import LETTERS, mix64, words_of

BITS, PER_CLASS, EPOCHS, SEEN, THRESHOLD = 20, 5000, 3, 30_000, 0.5
ALPHA, BETA, L1, L2, BOOST = 2.0, 1.0, 10.0, 0.0, 3.0


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features of all texts, with repeats, and which text each is of."""
    words = words_of(column, lower=True, inside=LETTERS)
    n, of = np.diff(words.first), np.repeat(np.arange(len(column)), np.diff(words.first))
    pairs, first = words.windows(2)
    h, gap = words.hashes, np.zeros(0, np.uint64)
    near = np.flatnonzero(of[2:] == of[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
    if len(near):
        gap = mix64(h[near] * np.uint64(3) + mix64(h[near + 2]) + np.uint64(0x51ED270B))
    down = np.uint64(64 - bits)
    at = np.concatenate([mix64(h + np.uint64(1)) >> down, pairs >> down, gap >> down]).astype(np.int64)
    return at, np.concatenate([of, np.repeat(np.arange(len(n)), np.diff(first)), of[near]])


def _fit(bits: int, weight: dict[int, float], prior: float, alpha: float, beta: float, l1: float, l2: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << bits
        z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the intercept
        bound = np.full(size + 1, l1)
        bound[size] = 0.0

        def weights(i: np.ndarray) -> np.ndarray:
            own = z[i]
            return np.where(np.abs(own) <= bound[i], 0.0, -(own - np.sign(own) * bound[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

        for piece in cut(batches, "text", 1 << 20):
            at, of = features(piece.column("text"), bits)
            order = np.argsort(of, kind="stable")
            at, edges = at[order], np.searchsorted(of[order], np.arange(piece.num_rows + 1))
            for d, y in enumerate(piece.column("y").to_pylist()):
                i = np.append(np.unique(at[edges[d]:edges[d + 1]]), size)
                w = weights(i)
                p = 1 / (1 + np.exp(-np.clip(prior + w.sum(), -35, 35)))
                g = (p - y) * weight[y]
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
                n[i] += g * g
        w = weights(np.arange(size + 1))
        w[size] += prior
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": pa.array(some, pa.int64()), "w": pa.array(w[some], pa.float64())})
    return run


@dataclass(frozen=True)
class Model:
    """Non-zero weights by coordinate, sorted; the coordinate 2**bits is the intercept."""

    at: np.ndarray
    w: np.ndarray
    bits: int
    constant: float | None = None

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        table = np.zeros((1 << self.bits) + 1)
        table[self.at] = self.w
        at, of = features(column, self.bits)
        hit = np.flatnonzero(table[at])
        pair = np.unique(of[hit] * (1 << self.bits) + at[hit])  # each feature of a text counts once
        total = np.bincount(pair >> self.bits, table[pair & ((1 << self.bits) - 1)], len(column)) + table[-1]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, per_class: int = PER_CLASS, epochs: int = EPOCHS, seen: int = SEEN, alpha: float = ALPHA, beta: float = BETA,
        l1: float = L1, l2: float = L2, boost: float = BOOST) -> Model:
    rows, share = sample(docs, labels, "toxic", per_class)
    if len(share) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), bits, float(next(iter(share), 0.5)))
    used = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = {0: float(share[0]), 1: boost * share[1]}
    n = sum(used.values())
    if len(used) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), bits, share[1] / (share[0] + share[1]))
    weight = {y: whole[y] / used[y] * n / sum(whole.values()) for y in whole}
    epochs = max(epochs, -(-seen // n))
    turns = rows.withColumn("epoch", F.explode(F.array(*[F.lit(k) for k in range(epochs)])))
    stream = turns.repartition(1).sortWithinPartitions("epoch", "place", "doc_id").select("text", "y")
    got = stream.mapInArrow(_fit(bits, weight, math.log(whole[1] / whole[0]), alpha, beta, l1, l2), "at long, w double").toPandas()
    return Model(got["at"].to_numpy(np.int64), got["w"].to_numpy(float), bits)


def mark(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in cut(batches, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": pa.array(model.scores(piece.column("text")))})
    scored = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

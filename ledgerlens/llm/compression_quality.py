"""Quality by compression: a text is like the texts whose dictionary shortens it more.

Two zstandard dictionaries are trained on labelled good and bad texts.  A text is compressed with each and with
none; the difference of the sizes with the dictionaries, normalised by their sum, and the sizes relative to the text's own, go into a logistic
calibration fitted on other labelled rows, weighted to the labels' own shares.  So the score is the
probability of label 1.  Both samples are bounded: ``PER_CLASS`` rows of each label, half of them for the dictionaries (of which texts of up to
``SAMPLE_CHARS`` characters are used), half for the calibration.  Scoring reads every text whole, one at a time, and shuffles nothing.

Null and empty texts get the calibration's value for an empty text.  Without rows of both labels, every score is
the share of label 1 (0.5 without any).  Repeated rows get equal scores; a null doc_id is held out.  Extra columns are ignored by ``mark`` and
kept by ``keep``.  An empty table gives an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, short_batches, worker_cache
from .labelled import sample

PER_CLASS, SAMPLE_CHARS, DICTIONARY, LEVEL, THRESHOLD = 6000, 20_000, 112_640, 3, 0.3


def _compressors(good: bytes, bad: bytes, level: int) -> tuple:
    key, kept = (hash(good), hash(bad), level), worker_cache("compression")
    if key not in kept:
        import zstandard
        plain = {"level": level, "write_content_size": False, "write_dict_id": False}
        made = [zstandard.ZstdCompressor(**plain)]
        for data in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=level)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, **plain))
        kept.clear()
        kept[key] = tuple(made)
    return kept[key]


def _sizes(texts, good: bytes, bad: bytes, level: int) -> np.ndarray:
    none, with_good, with_bad = _compressors(good, bad, level)
    rows = []
    for text in texts:
        data = (text or "").encode()
        rows.append((len(data), len(none.compress(data)), len(with_good.compress(data)), len(with_bad.compress(data))))
    return np.array(rows, float).reshape(-1, 4)


def _terms(sizes: np.ndarray) -> np.ndarray:
    """What the calibration weighs: the normalised difference, relative sizes, length, and their products."""
    length, none, good, bad = sizes.T
    length = np.maximum(length, 1)
    base = np.stack([(bad - good) / (bad + good), np.log(good / length), np.log(bad / length), np.log(none / length), np.log(length)], 1)
    i, j = np.triu_indices(base.shape[1])
    return np.hstack([base, base[:, i] * base[:, j]])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of standardised terms, intercept first, by Newton's method."""
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    hold = ridge * weight.sum() * np.r_[0, np.ones(x.shape[1])]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(hold + 1e-9), a.T @ (weight * (p - y)) + hold * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    good: bytes = b""
    bad: bytes = b""
    level: int = LEVEL
    mean: tuple = ()
    scale: tuple = ()
    weights: tuple = ()
    constant: float | None = None

    def scores(self, texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = (_terms(_sizes(texts, self.good, self.bad, self.level)) - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -35, 35)))

    def score(self, text: Column) -> Column:
        model = self

        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(model.scores(texts), dtype="float64")
        return F.pandas_udf(run, "double")(text)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, dictionary: int = DICTIONARY, level: int = LEVEL) -> Model:
    import zstandard
    rows, share = sample(docs, labels, "quality", per_class)
    if len(share) < 2:
        return Model(constant=float(next(iter(share), 0.5)))
    half = F.pmod("place", F.lit(2)) == 0
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows.where(half & (F.length("text") <= SAMPLE_CHARS) & (F.length("text") >= 8)).select("y", "text").orderBy("place", "doc_id").limit(2 * per_class).toLocalIterator():
        texts[r["y"]].append(r["text"].encode())
    try:
        bad, good = (zstandard.train_dictionary(dictionary, texts[y]).as_bytes() for y in (0, 1))
    except zstandard.ZstdError:  # too little text to train on: the texts themselves are the dictionary
        bad, good = (b"\n".join(texts[y])[-dictionary:] or b"\n" for y in (0, 1))
    kept = rows.where(~half)

    def measure(batches):
        for batch in batches:
            sizes = _sizes(batch["text"], good, bad, level)
            yield pd.DataFrame({"y": batch["y"], "size": sizes[:, 0], "none": sizes[:, 1], "good": sizes[:, 2], "bad": sizes[:, 3]})
    got = kept.select("y", "text").mapInPandas(measure, "y int, size double, none double, good double, bad double").toPandas()
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        return Model(constant=share[1] / (share[0] + share[1]))
    weight = np.where(y == 1, share[1] / max((y == 1).sum(), 1), share[0] / max((y == 0).sum(), 1))
    x = _terms(got[["size", "none", "good", "bad"]].to_numpy(float))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights = _logistic((x - mean) / scale, y, weight / weight.mean())
    return Model(good, bad, level, tuple(mean), tuple(scale), tuple(weights))


def mark(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels, **how)
    scored = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows whose score reaches the threshold, with all columns."""
    model = fit(docs, labels, **how)
    return short_batches(docs).where(model.score(F.col("text")) >= threshold)

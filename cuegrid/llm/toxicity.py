"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word skipped of a text (runs of letters, lower-cased), hashed
into 2^20 coordinates. FTRL-proximal keeps a learning rate for each coordinate and an L1 term that leaves most weights
at exactly zero, so what tasks are sent is a short list of (coordinate, weight): at most 2^20, in practice a few hundred.

Training reads about `per_class` labelled texts of each class (a documented bound, drawn by a hash) in one task; labels that repeat count once,
three quarters for the weights and one quarter to calibrate the scores; scoring is a pass over all texts.

Defined results: null and empty texts have no features and get the score of the intercept alone; unlabelled rows, null
labels and null texts teach nothing; a positive label counts as 1; without labels of both classes every score is 0.
Rows are scored each for itself; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import sample_about

LETTERS = re.compile(r"[^\W\d_]+")
BITS = 20
#: Words whose hashes a task keeps. The table starts afresh when full, which changes no score.
KEPT = 300_000
THRESHOLD = 0.7


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) >= KEPT:
            self.clear()
        if len(word) <= 40:
            self[word] = h
        return h


_hashes = WordHashes()


def mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Coordinates of a text, with repeats."""
    words = LETTERS.findall(text.lower()) if text else []
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    shifted = h << np.uint64(32)
    return np.concatenate([mixed(h, 1), mixed(shifted[:-1] ^ h[1:], 2), mixed(shifted[:-2] ^ h[2:], 3)])


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2 terms; the last coordinate is the intercept, which is not shrunk."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def calibrated(margins: np.ndarray, labels: np.ndarray, positive: float = 0.4) -> tuple[float, float]:
    """(slope, shift) of a logistic curve over margins of texts that the weights were not fitted on (Platt scaling).

    The classes weigh `positive` and 1 - `positive` in all, so the score does not depend on how rare the label is.
    """
    a, b, n1, n0 = 1.0, 0.0, labels.sum(), (1 - labels).sum()
    if not n1 or not n0:
        return a, b
    weight = np.where(labels == 1, positive / n1, (1 - positive) / n0)
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, h = weight * (p - goal), weight * p * (1 - p) + 1e-9
        slope = np.array([[(h * margins * margins).sum() + 1e-4, (h * margins).sum()], [(h * margins).sum(), h.sum()]])
        step = np.linalg.solve(slope, [(g * margins).sum() + 1e-4 * (a - 1), g.sum()])
        a, b = max(a - step[0], 0.1), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4_000, epochs: int = 3) -> tuple[list[int], list[float], float] | None:
    """(coordinates, weights, intercept) from doc_id, text and doc_id, toxic; None without both classes.

    The labels are drawn first: about 2 * per_class rows, which are sent to the tasks that read the texts.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "doc_id", "text"])
        seen = [np.append(np.unique(features(t)), 1 << BITS) for t in rows["text"]]
        labels = rows["toxic"].to_numpy()
        if not 0 < labels.sum() < len(labels):
            return pd.DataFrame({"at": [[]], "w": [[]], "intercept": [None]})
        model = Ftrl()
        for _ in range(epochs):
            for i, (at, y) in enumerate(zip(seen, labels)):
                if i % 4:
                    model.learn(at, y)
        w = model.weights(np.arange((1 << BITS) + 1))
        slope, shift = calibrated(np.array([w[f].sum() for f in seen[::4]]), labels[::4])
        at = np.flatnonzero(w[:-1])
        return pd.DataFrame({"at": [at.tolist()], "w": [(slope * w[at]).tolist()], "intercept": [float(slope * w[-1] + shift)]})

    known = labels.where("toxic is not null").select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).distinct()
    drawn = sample_about(known, "toxic", per_class, "toxicity")
    sample = (docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
              .withColumn("turn", F.xxhash64("doc_id", F.lit("order"))).withColumn("model", F.lit(1)))
    found = sample.groupBy("model").applyInPandas(fit, "at array<long>, w array<double>, intercept double").first()
    return (found["at"], found["w"], found["intercept"]) if found and found["intercept"] is not None else None


def scored(text: Column, model: tuple[list[int], list[float], float] | None, spark) -> Column:
    """The probability of label 1 for a text column."""
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w, intercept = shared.value
        table = np.zeros(1 << BITS)
        table[at] = w
        for texts in batches:
            sums = np.full(len(texts), intercept)
            for i, t in enumerate(texts):
                if t:
                    f = features(t)
                    f = np.unique(f[table[f] != 0.0])
                    sums[i] += table[f].sum()
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35))))

    return F.pandas_udf(rows, "double")(text)

"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

A document is a sparse vector over 2^18 buckets: its words, runs of signs, and pairs of neighbours (equal ones
as one kind), hashed, each bucket
weighted by the logarithm of its count and the vector scaled to length one. Weights follow FTRL-Proximal (a step size for each
bucket, L1 and L2), fitted in one task on a bounded sample of labelled rows; scoring is a sparse dot product in each task.

Edge cases: null and empty texts have no features and get the score of the intercept; without labelled rows every score is 0.5;
labels of one kind only fit an intercept; equal texts score alike, however long; null and repeated identifiers
are rows like any other and may be text; an empty table gives an empty result.
"""

import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.labelled import SAMPLE, held_out, training_rows

BITS, THRESHOLD = 18, 0.3
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 0.1, 0.1, 4
_SAME = np.uint64(0xD6E8FEB86659FD93)  # a word twice in a row: one bucket for all words
_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+")


def features(text: "str | None", bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (without repeats, in order) and their weights."""
    words = _TOKEN.findall((text or "").encode("utf-8", "replace"))
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0)
    h = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xBF58476D1CE4E5B9)
    pairs[h[:-1] == h[1:]] = _SAME
    all_ = np.concatenate([h * np.uint64(0x94D049BB133111EB), pairs]) >> np.uint64(64 - bits)
    index, count = np.unique(all_, return_counts=True)
    x = np.log1p(count)
    return index.astype(np.int64), x / np.sqrt((x * x).sum())


class Ftrl:
    """Per-coordinate FTRL-Proximal for logistic loss; coordinate 2^bits is the intercept, without L1."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.intercept = 1 << bits

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, l1 = self.z[i], np.where(i == self.intercept, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int, weight: float = 1.0) -> None:
        i, x = np.append(i, self.intercept), np.append(x, 1.0)
        w = self.weights(i)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA * w
        self.n[i] += g * g

    def fitted(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z)))


def _fit(frames):
    rows = [r for f in frames for r in zip(f["doc_id"].to_list(), f["text"].to_list(), f["y"].to_list())]
    rows.sort(key=lambda r: (crc32(str(r[0]).encode()), str(r[0]), r[1] or ""))
    model, seen = Ftrl(), [(features(t), y) for _, t, y in rows]
    ones = sum(y for _, y in seen)
    rare = np.sqrt(max(1, len(seen) - ones) / max(1, ones))  # between the labels' shares and equal shares
    for _ in range(EPOCHS):
        for (i, x), y in seen:
            model.learn(i, x, y, rare if y else 1 / rare)
    w = model.fitted()
    at = np.flatnonzero(w)
    yield pd.DataFrame({"i": at, "w": w[at]})


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights of 2^18 buckets and the intercept. The sample is bounded, so one task fits it and the driver gets at most 2 MB."""
    rows = training_rows(docs, labels, target, sample).repartition(1)  # the scan stays parallel; only the sample meets
    w = np.zeros((1 << BITS) + 1)
    for r in rows.mapInPandas(_fit, "i long, w double").toLocalIterator():
        w[r["i"]] = r["w"]
    return w


def score(w: np.ndarray, text: "str | None") -> float:
    i, x = features(text)
    return float(1 / (1 + np.exp(-np.clip(w[i] @ x + w[-1], -30, 30))))


def score_column(spark: SparkSession, weights: np.ndarray):
    """A function from a text column to its score."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([score(shared.value, t) for t in texts], dtype=float)

    return scored


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scorer = score_column(docs.sparkSession, fit(docs, labels))
    scored = docs.select("doc_id", held_out().alias("held_out"), scorer(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

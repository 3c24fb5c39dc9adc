"""Toxicity by maximum-scoring segments of token log-odds.

A token's log-odds between toxic and clean documents are estimated under a Dirichlet prior (half a document for each word, and
the words of both together), counting a document once for each word, so that one that repeats a word is no evidence of
its own. Only what exceeds its standard errors counts; every other token costs a small drift, so the expected score of
clean text is negative. One linear scan finds all maximal scoring segments of a text. Segment scores follow an
extreme-value law on clean text: with lambda solving E[exp(lambda s)] = 1, a segment of score S in n tokens has the
bit score lambda S - log n; the text's bit scores are summed over its significant segments, and a logistic curve, fitted on
a bounded sample of labelled rows, gives the probability.

Edge cases: null and empty texts have no segment and get the score of a text without any; without labelled rows every score
is 0; labels of one kind only give no tokens and the share of that label; equal texts score alike, however long; null and repeated identifiers
are rows like any other and may be text; an empty table gives an empty result.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.labelled import held_out, training_rows

PRIOR = 500.0  # weight of the informative prior, in words of documents
FLAT = 0.5  # weight of the flat prior, for each word
Z = 3.0  # standard errors that a token's log-odds have to exceed
DRIFT = 0.35  # cost of any other token
SAMPLE = 40_000  # labelled rows the model is fitted on at most, a fixed bound
SIGNIFICANT = 0.0  # bit score from which a segment counts
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W_]+")
_SPARK_WORD = "[\\p{L}\\p{N}]+"


def token_scores(counts: DataFrame, prior: float = PRIOR, z: float = Z) -> DataFrame:
    """(word, toxic, clean) counts -> (word, s): log-odds ratio under the prior, less z standard errors, where positive."""
    total = counts.agg(F.sum("toxic").alias("nt"), F.sum("clean").alias("nc"))
    both = counts.crossJoin(F.broadcast(total))  # one row
    share = (F.col("toxic") + F.col("clean")) / (F.col("nt") + F.col("nc")) * prior + FLAT
    rated = both.select("word", "toxic", "clean", "nt", "nc", share.alias("a"))
    odds = lambda y, n: F.log((F.col(y) + F.col("a")) / (F.col(n) + prior - F.col(y) - F.col("a")))
    error = F.sqrt(1 / (F.col("toxic") + F.col("a")) + 1 / (F.col("clean") + F.col("a")))
    s = odds("toxic", "nt") - odds("clean", "nc") - z * error
    return rated.select("word", s.alias("s"), ((F.col("clean") + FLAT) / F.col("nc")).alias("p")).where("s > 0")


class Scorer:
    """Scores of words, the drift, and what turns segment scores into a probability."""

    def __init__(self, scores: dict, clean_share: dict, drift: float = DRIFT):
        self.scores, self.drift = scores, drift
        self.rate = self._rate(clean_share)
        self.curve = (0.0, -30.0)

    def _rate(self, share: dict) -> float:
        """lambda > 0 with sum over clean tokens of p exp(lambda s) = 1."""
        s = np.array([self.scores[w] for w in share], dtype=float)
        p = np.maximum(np.array([share[w] for w in share], dtype=float), 1e-9)
        rest = max(1e-9, 1 - p.sum())
        lo, hi = 0.0, 50.0
        for _ in range(80):
            mid = (lo + hi) / 2
            over = (p * np.exp(np.minimum(mid * s, 700))).sum() + rest * np.exp(-mid * self.drift) > 1
            lo, hi = (lo, mid) if over else (mid, hi)
        return lo or 1.0

    def segments(self, words: list) -> list:
        """All maximal scoring segments (first word, end, score), in one pass over the words that score (Ruzzo and Tompa)."""
        get, kept, total, last = self.scores.get, [], 0.0, 0
        scored = [(i, s) for i, s in enumerate(map(get, words)) if s is not None and not (i and words[i - 1] == words[i])]
        for at, s in scored:  # a word said again and again counts once
            left = total - self.drift * (at - last)
            total, last = left + s, at + 1
            seg = (at, left, total)
            while kept:
                j = len(kept) - 1
                while j >= 0 and kept[j][1] >= seg[1]:
                    j -= 1
                if j < 0 or kept[j][2] >= seg[2]:
                    break
                seg = (kept[j][0], kept[j][1], seg[2])
                del kept[j:]
            kept.append((*seg, at + 1))
        return [(k[0], k[3], k[2] - k[1]) for k in kept]

    def bits(self, text) -> float:
        """Sum of the bit scores of the significant segments."""
        words = _WORD.findall((text or "").lower())
        found = self.segments(words) if words else []
        length = np.log(max(len(words), 1))
        return float(sum(b for *_, s in found if (b := self.rate * s - length) > SIGNIFICANT))

    def passages(self, text) -> list:
        """Significant segments of a text: (first word, end, bit score)."""
        words = _WORD.findall((text or "").lower())
        length = np.log(max(len(words), 1))
        return [(a, b, float(self.rate * s - length)) for a, b, s in self.segments(words) if self.rate * s - length > SIGNIFICANT]

    def probability(self, bits):
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * np.log1p(bits) + b, -30, 30)))

    def calibrate(self, bits: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of y on log(1 + bits) by Newton steps, slightly ridged so that a clean split stays finite."""
        if not len(y):
            return
        x = np.column_stack([np.log1p(bits), np.ones(len(y))])
        w = np.array([0.0, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])
        ridge = np.diag([0.05, 0.001])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge
            step = np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.curve = (float(max(w[0], 0.0)), float(w[1]))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """Token scores and calibration from a bounded sample of labelled rows; the driver gets the token table and a number a row of the sample."""
    rows = training_rows(docs, labels, target, sample).cache()
    words = rows.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_SPARK_WORD), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    table = sorted(token_scores(counts).collect())  # words of the bounded sample that tell the labels apart
    scorer = Scorer({r["word"]: r["s"] for r in table}, {r["word"]: r["p"] for r in table})
    got = rows.select("y", _bits(scorer)("text").alias("bits")).collect()  # at most `sample` rows
    rows.unpersist()
    scorer.calibrate(np.array([r["bits"] for r in got]), np.array([r["y"] for r in got], dtype=float))
    return scorer


def _bits(scorer: Scorer):
    @F.pandas_udf("double")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([scorer.bits(t) for t in texts], dtype=float)

    return bits


def score_column(spark: SparkSession, scorer: Scorer):
    """A function from a text column to its score."""
    shared = spark.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        s = shared.value
        return pd.Series(s.probability(np.array([s.bits(t) for t in texts], dtype=float)))

    return scored


def toxic_passages(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Every significant passage: doc_id, first_word, end_word, bit_score."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("array<struct<first_word:int,end_word:int,bit_score:double>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("first_word", "end_word", "bit_score"), p)) for p in shared.value.passages(t)] for t in texts])

    return docs.select("doc_id", F.inline(found(F.col("text"))))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = score_column(docs.sparkSession, fit(docs, labels))
    scored = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

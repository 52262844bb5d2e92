"""Toxicity by cumulative-link ordinal regression.

Severity has the grades 0 (not toxic), 1 (toxic in a text of good quality) and 2 (toxic in a poor
one). A text is a sparse vector of hashed words and word beginnings (lowered, letters and digits;
1 + log of their count). One weight vector is shared by all thresholds: ``P(grade > k) = sigmoid(w.x - theta_k)``
with ordered thetas. The expected severity is the sum of these over k; a text is toxic if it is
more likely above grade 0 than at it.

The model is fitted on a bounded, documented sample: at most ``SAMPLE`` labelled texts, those with
the smallest hash of doc_id. Features of the sample are made on the executors and the weights are
fitted on the driver. Scoring reads every text whole, in one pass without a shuffle. Null and empty
texts have no features and score with the thresholds alone. Labels without doc_id or toxic are left
out; of repeated labels of a document the most severe counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table, with_rows
from tidemark.llm.decontaminate import words_of

BUCKETS = 1 << 18
GRADES = 3
SAMPLE = 20_000
# Texts of the sample that must have a bucket for it to get a weight.
LEAST_TEXTS = 3
# And how much more often than a text at large such a text must be toxic.
LIFT = 1.5
# Beginnings of longer words, in bytes, that are features besides whole words.
PREFIXES = (4,)
ROUNDS, STEP, SPARSE = 300, 0.5, 5e-5


class WordBuckets(dict):
    """Bucket of a word, remembered; the memory starts anew beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word) % BUCKETS
        if len(self) >= 500_000:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def features(text: str | None, known: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their values. ``known`` is the memory of a task and ends with it."""
    words = words_of(text)
    words += [w[:n] + b"-" for n in PREFIXES for w in words if len(w) > n]
    found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    bucket, count = np.unique(found, return_counts=True)
    return bucket, 1 + np.log(count)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray  # one a bucket, shared by all thresholds
    thresholds: np.ndarray  # ascending, one less than grades

    def score(self, text: str | None, known: WordBuckets) -> tuple[float, float]:
        """(expected severity, probability of any toxicity)."""
        bucket, value = features(text, known)
        above = sigmoid(float(self.weights[bucket] @ value) - self.thresholds)
        return float(above.sum()), float(above[0])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int = GRADES) -> OrdinalModel:
    """Fit by proximal adaptive gradient steps (many weights end at exactly zero)."""
    weights = np.zeros(BUCKETS)
    if not rows:
        return OrdinalModel(weights, np.arange(1.0, grades))
    grade = np.array([g for _, _, g in rows])
    texts, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for bucket, _, g in rows:  # a text has each bucket once
        texts[bucket] += 1
        toxic[bucket] += g > 0
    telling = (texts >= LEAST_TEXTS) & (toxic >= LIFT * (grade > 0).mean() * texts)
    # Only what can get a weight is laid out for all texts together.
    kept = [telling[b] for b, _, _ in rows]
    names, column = np.unique(np.concatenate([b[k] for (b, _, _), k in zip(rows, kept)]), return_inverse=True)
    value = np.concatenate([v[k] for (_, v, _), k in zip(rows, kept)]).astype(float)
    owner = np.repeat(np.arange(len(rows)), [int(k.sum()) for k in kept])
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-8)
    share = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share[0] / (1 - share[0]))
    gaps = np.maximum(np.diff(-np.log(share / (1 - share))), 0.1)
    theta, seen_theta = np.concatenate([[first], np.log(gaps)]), np.full(grades - 1, 1e-8)
    n, at = len(rows), np.arange(len(rows))
    for _ in range(ROUNDS):
        cut = np.concatenate([[-np.inf], theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))]), [np.inf]])
        s = np.bincount(owner, value * w[column], n)
        # P(grade <= k) at the upper and lower end of each text's grade.
        upper = np.where(np.isinf(cut[grade + 1]), 1.0, sigmoid(cut[grade + 1] - s))
        lower = np.where(np.isinf(cut[grade]), 0.0, sigmoid(cut[grade] - s))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        push = (du - dl) / n  # d loss / d s
        g = np.bincount(column, value * push[owner], len(names))
        by_cut = np.zeros((n, grades + 1))
        by_cut[at, grade + 1] -= du / n
        by_cut[at, grade] += dl / n
        per_cut = by_cut.sum(axis=0)[1:grades]
        gt = np.concatenate([[per_cut.sum()], [per_cut[k:].sum() * np.exp(theta[k]) for k in range(1, grades - 1)]])
        seen += g * g
        seen_theta += gt * gt
        rate = STEP / np.sqrt(seen)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * SPARSE, 0)
        theta = theta - STEP * 0.2 * gt / np.sqrt(seen_theta)
    weights[names] = w
    return OrdinalModel(weights, theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))]))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, grade) of at most ``sample`` labelled documents, the smallest hashes of doc_id.

    Of repeated rows of a doc_id the smallest text counts, so the bound holds.
    """
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 1, 1).otherwise(2)
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(grade).alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("text", "grade")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    known = WordBuckets()

    def make(columns: list[pa.Array]) -> list:
        made = [features(x.as_py(), known) for x in columns[0]]
        return [[b.tolist() for b, _ in made], [v.tolist() for _, v in made]]

    kinds = {"bucket": T.ArrayType(T.IntegerType()), "value": T.ArrayType(T.FloatType())}
    rows = with_rows(labelled(docs, labels, sample), kinds, make, "text").drop("text").toLocalIterator()
    # In one order, however the rows arrive.
    found = [(np.array(r["bucket"], np.int32), np.array(r["value"], np.float32), r["grade"]) for r in rows]
    found.sort(key=lambda x: (x[2], len(x[0]), xxhash.xxh3_64_intdigest(x[0].tobytes())))
    return fit(found)


def score_toxicity(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``p_toxic`` and ``toxic``."""
    known = WordBuckets()
    used = np.flatnonzero(model.weights)
    values, thresholds = model.weights[used], model.thresholds

    def make(columns: list[pa.Array]) -> list:
        weights = np.zeros(BUCKETS)
        weights[used] = values
        own = OrdinalModel(weights, thresholds)
        scores = [own.score(x.as_py(), known) for x in columns[0]]
        return [[s for s, _ in scores], [p for _, p in scores], [p >= 0.5 for _, p in scores]]

    kinds = {"severity": T.DoubleType(), "p_toxic": T.DoubleType(), "toxic": T.BooleanType()}
    return with_rows(docs, kinds, make, text)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", F.round("severity", 6).alias("severity"), F.round("p_toxic", 6).alias("p_toxic"), "toxic"
    )

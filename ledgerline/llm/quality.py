"""Operator 5, quality classifier: Naive Bayes support vectors (NBSVM).

Indicators of byte n-grams are scaled by the classes' log-count ratios; a linear hinge-loss model on the
scaled, length-normalised features is fitted by dual coordinate descent; a logistic curve over the margin
turns it into a probability of label 1. The model is fitted on a bounded labelled sample
(``features.SAMPLE_ROWS`` rows, label folds as stated there); tasks reduce sample texts to features, so the
driver only receives bucket numbers. Every document is scored from its whole text alone.

Defined results: null and empty texts have no features and get the score of the bare intercept; repeated rows
get a row each; without labelled rows, or with one class only, every score is that class's share (0.5
without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import give_back, id_and_text, map_arrow, slices, texts_of
from ledgerline.llm.features import BITS, BUCKETS, SAMPLE_ROWS, fold, gram_features, labelled_sample

THRESHOLD = 0.3
PENALTY = 1.0
EPOCHS = 12
SMOOTHING = 1.0


@dataclass
class Model:
    weights: np.ndarray    # per bucket: hinge-loss weight times log-count ratio
    ratio: np.ndarray      # log-count ratio, for the length of the scaled features
    bias: float
    slope: float           # of the logistic curve over the margin
    offset: float

    def score(self, features: np.ndarray) -> float:
        if not len(features):
            margin = self.bias
        else:
            r = self.ratio[features]
            length = float(np.sqrt(r @ r)) or 1.0
            margin = float(self.weights[features].sum()) / length + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, buckets: int) -> np.ndarray:
    """log of the share of a bucket among class 1's indicators over its share among class 0's, smoothed."""
    counts = np.full((2, buckets), SMOOTHING)
    for label in (0, 1):
        own = [r for r, v in zip(rows, y) if v == label]
        if own:
            counts[label] += np.bincount(np.concatenate(own), minlength=buckets)
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, buckets: int,
                            penalty: float = PENALTY, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss; rows hold buckets, values their features.

    One dual variable a row in [0, penalty], the rarer class weighted up; each step solves one of them exactly.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    share = max(1, min(int((y == 1).sum()), int((y == 0).sum()))) / len(y)
    bound = penalty * np.where((y == 1) == ((y == 1).mean() < 0.5), 0.5 / share, 0.5 / max(1 - share, 1e-9))
    square = np.array([v @ v + 1.0 for v in values])  # 1: the bias as a feature
    alpha, w, bias = np.zeros(len(y)), np.zeros(buckets), 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), bound[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


class Scaled:
    """Each row's log-count ratios, scaled to length 1; made when asked for, so that the sample is held as buckets only."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.rows, self.ratio = rows, ratio
        self.length = [np.sqrt(v @ v) or 1.0 for v in map(ratio.__getitem__, rows)]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ratio[self.rows[i]] / self.length[i]


def logistic_curve(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of P(1 | margin), by Newton steps on smoothed targets."""
    pos = (y == 1).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * margin).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS) -> Model:
    zero = np.zeros(buckets)
    if not len(y) or len(set(y.tolist())) < 2:
        share = float(np.mean(y)) if len(y) else 0.5
        return Model(zero, zero, 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    ratio = log_count_ratios(rows, y, buckets)
    values = Scaled(rows, ratio)
    w, bias = dual_coordinate_descent(rows, values, y, buckets)
    margin = np.array([w[r] @ v + bias for r, v in zip(rows, values)])
    return Model(w * ratio, ratio, bias, *logistic_curve(margin, y))


def sample_features(sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the bounded sample; tasks extract them, the driver gets bucket numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for b in (part for whole in batches for part in slices(whole, 200)):
            rows = [gram_features(t, seen).astype(np.int32).tobytes() for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column("y")], names=["f", "y"])

    got = map_arrow(sample, run, "f binary, y int").toArrow()
    rows = [np.frombuffer(x, np.int32) for x in got.column("f").to_pylist()]
    y = np.array(got.column("y").to_pylist(), np.int64)
    order = sorted(range(len(y)), key=lambda i: (sha256(rows[i]).digest(), y[i]))  # the order of tasks doesn't matter
    return [rows[i] for i in order], y[order]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    model = fit(*sample_features(labelled_sample(docs, labels, label, rows)))
    give_back()
    return model


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = sent.value, np.zeros(1 << BITS, bool)
        for b in (part for whole in batches for part in slices(whole)):
            scores = [m.score(gram_features(t, seen)) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())],
                                             names=["doc_id", "score"])

    rows = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_arrow(rows, run, "doc_id bigint, score double").select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) that the model does not reject."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = sent.value, np.zeros(1 << BITS, bool)
        for b in (part for whole in batches for part in slices(whole)):
            keep = [m.score(gram_features(t, seen)) >= threshold for t in texts_of(b.column("text"))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)

"""Operator 7, toxicity: cumulative-link ordinal regression over sparse words.

Severity grades 0 < 1 < ... < K-1 share one weight vector; ordered thresholds t_1 < ... < t_(K-1) separate
them: P(grade >= k | x) = sigmoid(w.x - t_k). Features are indicators of hashed words and frequent stems that are
associated with toxicity in the labelled sample; the expected severity is the sum of the P(grade >= k).

Labels say only toxic or not. Grades are laid over them by evidence: a document not marked is grade 0, a
marked one has grade 1, 2 or 3 by how often words of strong association occur in it (``GRADE_COUNTS``). Callers
with real grades pass them to :func:`fit` directly.

The model is fitted on a bounded labelled sample (``features.SAMPLE_ROWS``, held-out fold excluded); tasks
reduce the texts to buckets. Each document is scored from its whole text.

Defined results: null and empty texts have no features and get the severity of the thresholds alone; repeated
rows get a row each; without labelled rows of both kinds every severity is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import id_and_text, map_arrow, texts_of
from ledgerline.llm.features import BITS, SAMPLE_ROWS, fold, labelled_sample, word_features

GRADE_COUNTS = (2, 5)   # occurrences from which a marked document has grade 2 and grade 3
MIN_DOCUMENTS = 4       # documents of the sample that must hold a feature
MIN_Z = 3.5             # standard errors by which its log odds must exceed 0
STRONG = 1.5            # log odds of words that count as evidence for a grade
THRESHOLD = 0.5         # of P(grade >= 1)
STEPS, RATE, DECAY = 400, 0.1, 1e-4


@dataclass
class Model:
    weights: np.ndarray      # per bucket; 0 for features that weren't selected
    thresholds: np.ndarray   # ascending, one less than grades

    def at_least(self, features: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. ."""
        x = float(self.weights[features].sum()) if len(features) else 0.0
        return 1 / (1 + np.exp(-np.clip(x - self.thresholds, -30, 30)))


def select_features(rows: list[np.ndarray], toxic: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets associated with toxic documents, and the log odds of all."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    counts = [np.bincount(np.concatenate([np.unique(r) for r, t in zip(rows, toxic) if t == k] or [np.zeros(0, np.int64)]),
                          minlength=buckets).astype(float) for k in (False, True)]
    a, b = counts[1] + 0.5, counts[0] + 0.5
    odds = np.log(a / (n1 - counts[1] + 0.5)) - np.log(b / (n0 - counts[0] + 0.5))
    error = np.sqrt(1 / a + 1 / b + 1 / (n1 - counts[1] + 0.5) + 1 / (n0 - counts[0] + 0.5))
    return np.flatnonzero((counts[0] + counts[1] >= MIN_DOCUMENTS) & (odds > MIN_Z * error)), odds


def grades_by_evidence(rows: list[np.ndarray], toxic: np.ndarray, odds: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    strong = np.zeros(len(odds), bool)
    strong[chosen[odds[chosen] >= STRONG]] = True
    count = np.array([int(strong[r].sum()) for r in rows])
    return np.where(toxic, 1 + sum((count >= g).astype(int) for g in GRADE_COUNTS), 0)


def fit(rows: list[np.ndarray], grade: np.ndarray, chosen: np.ndarray, n_grades: int, buckets: int) -> Model:
    """Maximum likelihood of the cumulative-link model with a penalty on the weights, by gradient steps (Adam).

    Thresholds are a first one and positive gaps, so they stay ordered.
    """
    place = np.full(buckets, -1)
    place[chosen] = np.arange(len(chosen))
    own = [np.unique(place[r]) for r in rows]
    own = [p[p >= 0] for p in own]
    row = np.repeat(np.arange(len(rows)), [len(p) for p in own])
    col = np.concatenate(own) if own else np.zeros(0, np.int64)
    k = n_grades - 1
    theta = np.concatenate([np.zeros(len(chosen)), [2.0], np.zeros(k - 1)])  # weights, first threshold, log gaps
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    one_hot = grade[:, None] == np.arange(n_grades)[None, :]
    for step in range(1, STEPS + 1):
        w, t = theta[:len(chosen)], np.concatenate([[theta[len(chosen)]], np.exp(theta[len(chosen) + 1:])]).cumsum()
        x = np.bincount(row, w[col], len(rows)) if len(row) else np.zeros(len(rows))
        p = 1 / (1 + np.exp(-np.clip(x[:, None] - t, -30, 30)))          # P(grade >= k)
        full = np.concatenate([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))], axis=1)
        mass = np.maximum((full[:, :-1] - full[:, 1:])[one_hot], 1e-9)
        slope = np.concatenate([np.zeros((len(rows), 1)), p * (1 - p), np.zeros((len(rows), 1))], axis=1)
        upper, lower = slope[:, :-1][one_hot], slope[:, 1:][one_hot]     # of the two thresholds around the grade
        dx = -(upper - lower) / mass / len(rows)
        dt = np.zeros(k)
        np.add.at(dt, np.maximum(grade - 1, 0), np.where(grade > 0, upper / mass, 0) / len(rows))
        np.add.at(dt, np.minimum(grade, k - 1), np.where(grade < k, -lower / mass, 0) / len(rows))
        grad = np.empty_like(theta)
        grad[:len(chosen)] = np.bincount(col, dx[row], len(chosen)) + DECAY * w if len(row) else DECAY * w
        tail = dt[::-1].cumsum()[::-1]                                    # a gap moves all thresholds above it
        grad[len(chosen)] = tail[0]
        grad[len(chosen) + 1:] = tail[1:] * np.exp(theta[len(chosen) + 1:])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    weights = np.zeros(buckets)
    weights[chosen] = theta[:len(chosen)]
    return Model(weights, np.concatenate([[theta[len(chosen)]], np.exp(theta[len(chosen) + 1:])]).cumsum())


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [word_features(t).astype(np.int32).tobytes() for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column("y")], names=["f", "y"])

    got = map_arrow(labelled_sample(docs, labels, label, rows), run, "f binary, y int").toArrow()
    order = sorted(zip(got.column("f").to_pylist(), got.column("y").to_pylist()))
    found = [np.frombuffer(f, np.int32) for f, _ in order]
    toxic = np.array([y for _, y in order], bool)
    buckets, grades = 1 << BITS, len(GRADE_COUNTS) + 2
    if not toxic.any() or toxic.all():
        return Model(np.zeros(buckets), np.full(grades - 1, 30.0))
    chosen, odds = select_features(found, toxic, buckets)
    return fit(found, grades_by_evidence(found, toxic, odds, chosen), chosen, grades, buckets)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: expected severity, most likely grade, P(grade >= 1) as score, and toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        useful = m.weights != 0
        for b in batches:
            p = []
            for t in texts_of(b.column("text")):
                f = word_features(t)
                p.append(m.at_least(np.unique(f[useful[f]])))
            p = np.array(p).reshape(-1, len(m.thresholds))
            mass = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(p.sum(axis=1), pa.float64()),
                 pa.array(mass.argmax(axis=1), pa.int32()), pa.array(p[:, 0], pa.float64())],
                names=["doc_id", "expected_severity", "grade", "score"])

    rows = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_arrow(rows, run, "doc_id bigint, expected_severity double, grade int, score double").select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "expected_severity", "grade", "score",
        (F.col("score") >= threshold).alias("toxic"))

"""Toxicity: a cumulative-link (proportional odds) model of severity grades.

P(grade <= k) = sigmoid(theta_k - w.x) over binary hashed words and word beginnings,
with one weight vector for all ordered thresholds; the output is the expected grade.

Grades: a ``grade`` column of the labels is used as it is.  The given tables hold only
toxic 0/1, so the query's labelled rows are graded from that: 0 if not toxic, else 1 to
3 by how many features of the text are marks of toxic texts (document frequencies of
the labelled sample), cut at the terciles of the toxic rows.

Fitted on at most ``most`` labelled rows (a documented bound; those whose ids hash
lowest); every row is scored in one pass without a shuffle.

Defined results: null text scores as an empty one; null labels are left out; repeated
rows count as often as they occur; without usable labels severity is 0; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .features import bag, collect_features, labelled_sample, row_sums

BITS, PREFIXES, TOP = 20, (3, 4, 5, 6), 3
SCHEMA = "doc_id long, severity double, toxic_probability double, toxic boolean"


@dataclass
class Ordinal:
    keys: np.ndarray  # features with a weight, ascending
    weights: np.ndarray
    thetas: np.ndarray

    def eta(self, bounds: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(bounds) - 1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return row_sums(np.where(self.keys[at] == keys, self.weights[at], 0.0), bounds)

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - eta[:, None], -40, 40)))


def train(grade: np.ndarray, bounds: np.ndarray, keys: np.ndarray, least: int = 4, z: float = 4.5, l1: float = 1e-4, rate: float = 0.3, epochs: int = 20, batch: int = 256, seed: int = 7) -> Ordinal:
    """AdaGrad with soft thresholds on the mean log-likelihood.

    Only features of at least ``least`` rows whose share of rows above grade 0 lies ``z``
    standard errors from the overall share get a weight; the rest are noise of rare words.
    """
    top = int(grade.max(initial=0))
    if not len(grade) or top == 0:
        return Ordinal(np.zeros(0, np.int32), np.zeros(0), np.full(max(top, 1), 40.0))
    used, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    share = np.clip((grade > 0).mean(), 1e-6, 1 - 1e-6)
    hits = np.bincount(inverse, np.repeat((grade > 0).astype(float), np.diff(bounds)), len(used))
    keep = (counts >= least) & (np.abs(hits - counts * share) >= z * np.sqrt(counts * share * (1 - share)))
    at = keep[inverse]
    cols = (np.cumsum(keep) - 1)[inverse[at]]
    b = np.concatenate(([0], np.cumsum(at)))[bounds]
    n, p = len(grade), int(keep.sum())
    rng, ranks = np.random.default_rng(seed), np.arange(top)
    w, gw = np.zeros(p), np.full(p, 1e-6)
    theta, gt = np.log((np.array([(grade <= k).sum() for k in ranks]) + 0.5) / (np.array([(grade > k).sum() for k in ranks]) + 0.5)), np.full(top, 1e-2)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // batch)):
            sizes = b[rows + 1] - b[rows]
            first = np.concatenate(([0], np.cumsum(sizes)))
            c = cols[np.repeat(b[rows] - first[:-1], sizes) + np.arange(first[-1])]
            of, y, r = np.repeat(np.arange(len(rows)), sizes), grade[rows], np.arange(len(rows))
            eta = np.bincount(of, w[c], len(rows))
            below = np.concatenate((np.zeros((len(rows), 1)), 1 / (1 + np.exp(-np.clip(theta[None, :] - eta[:, None], -40, 40))), np.ones((len(rows), 1))), axis=1)
            slope = below * (1 - below)
            prob = np.maximum(below[r, y + 1] - below[r, y], 1e-9)
            up, low = slope[r, y + 1] / prob, slope[r, y] / prob
            g = np.bincount(c, ((up - low) / len(rows))[of], p)
            t = np.array([low[y == k + 1].sum() - up[y == k].sum() for k in ranks]) / len(rows)
            gw += g * g
            gt += t * t
            w -= rate * g / np.sqrt(gw)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / np.sqrt(gw), 0)
            theta = np.maximum.accumulate(theta - rate * t / np.sqrt(gt) + 1e-9 * ranks)
    kept = np.flatnonzero(w)
    return Ordinal(used[keep][kept].astype(np.int32), w[kept], theta)


def grade_by_marks(toxic: np.ndarray, bounds: np.ndarray, keys: np.ndarray, top: int = TOP) -> np.ndarray:
    """0 for clean rows, 1..top for toxic ones by their number of marks: features at least 20 times as frequent in toxic rows."""
    used, inverse = np.unique(keys, return_inverse=True)
    is_toxic = np.repeat(toxic > 0, np.diff(bounds))
    bad, good = np.bincount(inverse[is_toxic], minlength=len(used)), np.bincount(inverse[~is_toxic], minlength=len(used))
    ratio = (bad / max(1, (toxic > 0).sum())) / ((good + 0.5) / max(1, (toxic <= 0).sum()))
    marks = row_sums(((ratio >= 20) & (bad >= 3))[inverse].astype(float), bounds)
    grade = np.zeros(len(toxic), np.int64)
    if (toxic > 0).any():
        edges = np.quantile(marks[toxic > 0], np.arange(1, top) / top)
        grade[toxic > 0] = 1 + np.searchsorted(edges, marks[toxic > 0], side="left")
    return grade


def fit(docs: DataFrame, labels: DataFrame, most: int = 9000, **options) -> Ordinal:
    column = "grade" if "grade" in labels.columns else "toxic"
    chosen = labelled_sample(docs, labels.where(F.col(column).isNotNull()).select("doc_id", column), most)
    _, y, bounds, keys, _ = collect_features(chosen, column, BITS, PREFIXES, with_dense=False)
    return train(y.astype(np.int64) if column == "grade" else grade_by_marks(y, bounds, keys), bounds, keys, **options)


def score(docs: DataFrame, model: Ordinal, threshold: float = 0.2) -> DataFrame:
    """doc_id, expected severity, P(grade >= 1) and whether that reaches ``threshold``."""

    def each(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                above = model.above(model.eta(*bag(part.column("text"), BITS, PREFIXES)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= threshold)], ["doc_id", "severity", "toxic_probability", "toxic"]
                )

    return docs.select("doc_id", "text").mapInArrow(each, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))

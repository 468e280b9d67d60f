"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + w.x + 1/2 sum_f [(V_f.x)^2 - (V_f^2).(x^2)]): every pair of
features interacts through low-rank factors, at a cost linear in the features of a text.

Fitted on at most ``most`` labelled rows (a documented bound; those whose ids hash
lowest), scored on every row without a shuffle: texts pass once through Arrow batches.

Inputs of a score: words, their structure and n_chars.  Labels, lang, source and
doc_id are never inputs.  Defined results: null text scores as an empty one; a null
n_chars is taken from the text; null labels are left out; repeated rows count as often
as they occur; without usable labels every score is 0.5; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, pieces
from .features import DENSE, bag, collect_features, dense, labelled_sample, row_sums

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Machine:
    bits: int
    mean: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray  # hashed words, then statistics
    v: np.ndarray  # the same by rank

    def inputs(self, bounds: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each word (texts are scaled to length 1) and the standardised statistics."""
        n = np.maximum(np.diff(bounds), 1)
        return np.repeat(1 / np.sqrt(n), np.diff(bounds)), np.clip((d - self.mean) / self.scale, -8, 8)

    def logit(self, bounds: np.ndarray, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
        x, s = self.inputs(bounds, d)
        m = 1 << self.bits
        out = self.w0 + row_sums(x * self.w[keys], bounds) + s @ self.w[m:]
        vx = self.v[keys] * x[:, None]
        first = row_sums(vx, bounds) + s @ self.v[m:]
        second = row_sums(vx * vx, bounds) + (s * s) @ (self.v[m:] ** 2)
        return out + 0.5 * (first * first - second).sum(axis=1)

    def score(self, bounds, keys, d) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(bounds, keys, d), -30, 30)))


def train(y: np.ndarray, bounds: np.ndarray, keys: np.ndarray, d: np.ndarray, bits: int = 16, rank: int = 4, epochs: int = 12, rate: float = 0.05, l2: float = 2e-5, batch: int = 256, seed: int = 11) -> Machine:
    """AdaGrad over mini-batches; the order and the start depend on ``seed`` alone."""
    rng, m = np.random.default_rng(seed), 1 << bits
    mean, scale = (d.mean(axis=0), np.maximum(d.std(axis=0), 1e-3)) if len(d) else (np.zeros(len(DENSE)), np.ones(len(DENSE)))
    if len(d):
        mean[-1], scale[-1] = 0.0, 1.0
    size = m + len(mean)
    fm = Machine(bits, mean, scale, 0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    if not len(y):
        fm.v[:] = 0
        return fm
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            sizes = bounds[rows + 1] - bounds[rows]
            b = np.concatenate(([0], np.cumsum(sizes)))
            at = np.repeat(bounds[rows] - b[:-1], sizes) + np.arange(b[-1])
            k = keys[at]
            x, s = fm.inputs(b, d[rows])
            vx = fm.v[k] * x[:, None]
            first = row_sums(vx, b) + s @ fm.v[m:]
            second = row_sums(vx * vx, b) + (s * s) @ (fm.v[m:] ** 2)
            z = fm.w0 + row_sums(x * fm.w[k], b) + s @ fm.w[m:] + 0.5 * (first * first - second).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            row = np.repeat(np.arange(len(rows)), sizes)
            dw, dv = np.zeros(size), np.zeros((size, rank))
            ex = err[row] * x
            dw[:m] = np.bincount(k, ex, m)
            dw[m:] = err @ s
            for f in range(rank):
                dv[:m, f] = np.bincount(k, ex * (first[row, f] - vx[:, f]), m)
            dv[m:] = s.T @ (err[:, None] * first) - (err @ (s * s))[:, None] * fm.v[m:]
            seen = np.concatenate((np.unique(k), np.arange(m, size)))
            for w, g, delta in ((fm.w, gw, dw), (fm.v, gv, dv)):
                step = delta[seen] + l2 * w[seen]
                g[seen] += step * step
                w[seen] -= rate * step / np.sqrt(g[seen])
            g0 += err.sum() ** 2
            fm.w0 -= rate * err.sum() / np.sqrt(g0)
    return fm


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 6000, **options) -> Machine:
    """``labels``: the rows to learn from (doc_id and ``label``)."""
    chosen = labelled_sample(docs, labels.where(F.col(label).isNotNull()).select("doc_id", label), most)
    _, y, bounds, keys, d = collect_features(chosen, label, options.get("bits", 16))
    return train((y > 0).astype(float), bounds, keys, d, **options)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, mod: int = 4, held: int = 2) -> DataFrame:
    def each(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                d = dense(part.column("text"), part.column("n_chars").to_numpy(zero_copy_only=False).astype(float))
                p = machine.score(*bag(part.column("text"), machine.bits), d)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(crc_mod(ids, mod) == held), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    return docs.select("doc_id", "text", "n_chars").mapInArrow(each, SCHEMA)


def quality_scores(docs: DataFrame, labels: DataFrame, learn_from=None) -> DataFrame:
    """Scores of every row; learns only from labels whose crc32(doc_id) mod 4 is not 2."""
    from .common import crc_of_id

    return score(docs, fit(learn_from or docs, labels.where(crc_of_id() % 4 != 2)))


def keep_good(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""

    def each(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                text = part.column(part.schema.get_field_index("text"))
                d = dense(text, part.column(part.schema.get_field_index("n_chars")).to_numpy(zero_copy_only=False).astype(float))
                yield part.filter(pa.array(machine.score(*bag(text, machine.bits), d) >= threshold))

    return docs.mapInArrow(each, docs.schema)

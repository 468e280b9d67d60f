"""Ridge regression from one pass of sums, its search, prediction and boosted trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import double_rank
from .ranks import spearman

ALPHAS = tuple(10.0**k for k in range(-4, 4))


def _joined(parts):
    """(rows, means, centred products) of all parts of (rows, means, centred products)."""
    n, mean, gram = 0, None, None
    for k, m, g in parts:
        if n:
            step = m - mean
            mean, gram = mean + step * (k / (n + k)), gram + g + np.outer(step, step) * (n * (k / (n + k)))
        else:
            mean, gram = m, g
        n += k
    return n, mean, gram


def _as_batch(key: int, n: int, mean: np.ndarray, gram: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([gram.tobytes()], pa.binary())], ["key", "n", "mean", "gram"])


def _from_rows(ns, means, grams):
    for n, m, g in zip(ns, means, grams, strict=True):
        m = np.frombuffer(m)
        yield n, m, np.frombuffer(g).reshape(len(m), len(m))


def _task_sums(batches):
    """One row a task: its rows, means and products about them, in one pass."""
    from pyspark import TaskContext

    def parts():
        for batch in batches:
            x = np.stack([col.to_numpy(zero_copy_only=False) for col in batch.columns])
            x = x[:, ~np.isnan(x).any(axis=0)]  # NULL is NaN here: complete rows only
            if x.shape[1]:
                m = x.mean(axis=1)
                x = x - m[:, None]
                yield x.shape[1], m, x @ x.T

    n, mean, gram = _joined(parts())
    if n:
        yield _as_batch(TaskContext.get().partitionId() // 64, n, mean, gram)


def _merged_sums(table):
    """The sums of some tasks as one row."""
    import pyarrow as pa

    return pa.Table.from_batches([_as_batch(table.column("key")[0].as_py(), *_joined(_from_rows(*[table.column(c).to_pylist() for c in ("n", "mean", "gram")])))])


@dataclass(frozen=True)
class Moments:
    """Sums of products of the features and the label: all that any alpha needs."""

    n: int
    mean: np.ndarray
    y_mean: float
    gram: np.ndarray
    xy: np.ndarray

    @staticmethod
    def of(df: DataFrame, features: list[str], y: str) -> Moments:
        cols = [*features, y]
        if len(cols) > 6:
            # One pass, one matrix a task, joined by 64 tasks: columns cost no plan of their squares or holes.
            sums = df.select(*[F.col(x).cast("double").alias(f"c{i}") for i, x in enumerate(cols)]).mapInArrow(_task_sums, "key int, n long, mean binary, gram binary")
            found = sorted(sums.groupBy("key").applyInArrow(_merged_sums, "key int, n long, mean binary, gram binary").collect(), key=lambda r: r["key"])
            if not found:
                raise ValueError("no complete rows to fit")
            n, mean, full = _joined(_from_rows(*zip(*[(r["n"], r["mean"], r["gram"]) for r in found], strict=True)))
            return Moments(n, mean[:-1], float(mean[-1]), full[:-1, :-1], full[:-1, -1])
        d = df.dropna(subset=cols)
        means = d.agg(F.count("*").alias("_rows"), *[F.avg(c).alias(c) for c in cols]).first()
        if not means["_rows"]:
            raise ValueError("no complete rows to fit")
        c = {x: F.col(x) - F.lit(means[x]) for x in cols}
        full = np.zeros((len(cols), len(cols)))
        pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
        row = d.agg(*[F.sum(c[cols[i]] * c[cols[j]]).alias(f"s{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            full[i, j] = full[j, i] = row[f"s{i}_{j}"]
        return Moments(means["_rows"], np.array([means[x] for x in features]), means[y], full[:-1, :-1], full[:-1, -1])

    def ridge(self, alpha: float) -> tuple[np.ndarray, float]:
        w = np.linalg.solve(self.gram + alpha * np.eye(len(self.xy)), self.xy)
        return w, self.y_mean - float(self.mean @ w)


def predict(features: list[str], weights, intercept: float) -> Column:
    """A linear combination; NULL where a feature is missing."""
    out = F.lit(float(intercept))
    for f, w in zip(features, weights, strict=True):
        out = out + F.lit(float(w)) * F.col(f)
    return out


def rank_ic(df: DataFrame, y: str, columns: list[str]) -> list[float]:
    """Spearman correlation of each column with y over all rows with both, for all columns at once."""
    return spearman(df, y, columns)


def search(train: DataFrame, valid: DataFrame, features: list[str], y: str, alphas=ALPHAS) -> list[tuple[float, float]]:
    """(alpha, rank IC on valid); one set of sums serves all."""
    m = Moments.of(train, features, y)
    models = [m.ridge(a) for a in alphas]

    def predictions(batch):
        """y and each model's ``predict``, summed in its order."""
        import pyarrow as pa

        x = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
        holes = np.zeros(batch.num_rows, dtype=bool)
        for c in batch.columns[1:]:
            if c.null_count:
                holes |= ~np.array(c.is_valid())
        out = [batch.column(0)]
        for weights, intercept in models:
            p = np.full(batch.num_rows, float(intercept))
            for w, v in zip(weights, x, strict=True):
                p += float(w) * v
            out.append(pa.array(p, mask=holes))
        return out

    return list(zip(alphas, spearman(valid, y, features, predictions, len(models)), strict=True))


def fit(train: DataFrame, valid: DataFrame, features: list[str], y: str, alphas=ALPHAS) -> tuple[float, np.ndarray, float]:
    """Best alpha (the earlier of equals), refitted on both parts."""
    found = [(a, s) for a, s in search(train, valid, features, y, alphas)]
    best = found[0][0]
    top = -np.inf
    for a, s in found:
        if s == s and s > top:
            best, top = a, s
    return best, *Moments.of(train.unionByName(valid), features, y).ridge(best)


def boosted_trees(df: DataFrame, features: list[str], y: str, rounds: int = 10, depth: int = 3, seed: int = 1):
    """Gradient-boosted regression trees of Spark ML on complete rows."""
    from pyspark.ml.regression import GBTRegressor

    rows = assembled(df, features, y)
    return GBTRegressor(featuresCol="features", labelCol=y, predictionCol="pred", maxIter=rounds, maxDepth=depth, seed=seed).fit(rows), rows


def assembled(df: DataFrame, features: list[str], y: str | None = None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=[*features, *([y] if y else [])]))


def best_rounds(fitted, valid: DataFrame, features: list[str], y: str, patience: int = 5) -> int:
    """Rounds after which the validation error has not fallen for ``patience`` rounds."""
    errors = fitted.evaluateEachIteration(assembled(valid, features, y), "squared")
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def cross_validated_trees(df: DataFrame, folds: DataFrame, date: str, features: list[str], y: str, label: str, rounds: int = 30, patience: int = 5, **options):
    """Rounds of each fold by early stopping on its validation dates, then a model of all rows with their median.

    ``folds``: fold, role (train, gap, valid), date; ``label``: the label to fit (winsorised, say), ``y`` the plain one.
    """
    found = []
    for r in folds.select("fold").distinct().orderBy("fold").collect():
        dates = folds.where(F.col("fold") == r["fold"])
        part = lambda role: df.join(F.broadcast(dates.where(F.col("role") == role).select(date)), date, "left_semi")  # noqa: B023, E731  dates
        train, valid = part("train"), part("valid")
        if train.isEmpty() or valid.isEmpty():
            continue
        fitted, _ = boosted_trees(train, features, label, rounds, **options)
        found.append((r["fold"], best_rounds(fitted, valid, features, y, patience)))
    median = int(np.median([n for _, n in found])) if found else rounds
    return found, boosted_trees(df, features, label, max(1, median), **options)[0]


def tune(train: DataFrame, valid: DataFrame, features: list[str], y: str, axes, grid: list[dict], fit_and_predict=None) -> list[tuple[dict, float]]:
    """Settings and their mean rank IC by time on ``valid``, the best first; equals in the order given."""
    from .evaluate import cross_sections

    def trees(setting):
        return boosted_trees(train, features, y, **setting)[0].transform(assembled(valid, features, y))

    scored = []
    for setting in grid:
        r = cross_sections((fit_and_predict or trees)(setting), axes, y, "pred").agg(F.avg("rankic")).first()[0]
        scored.append((setting, float("-inf") if r is None else r))
    return sorted(scored, key=lambda x: -x[1])


def lag_report(df: DataFrame, axes, features: list[str], y: str, lags: list[int], alpha: float = 10.0) -> list[tuple[int, float, float | None]]:
    """(lag, mean rank IC, its ratio to the first lag's): features that many rows old, refitted and evaluated."""
    from .evaluate import cross_sections
    from .prep import lagged

    out: list[tuple[int, float, float | None]] = []
    for lag in lags:
        old = lagged(df, axes, features, lag)
        pred = old.withColumn("pred", predict(features, *Moments.of(old, features, y).ridge(alpha)))
        r = cross_sections(pred, axes, y, "pred").agg(F.avg("rankic")).first()[0]
        first = out[0][1] if out else r
        out.append((lag, r, r / first if r is not None and first else None))
    return out


__all__ = ["ALPHAS", "Moments", "assembled", "best_rounds", "boosted_trees", "cross_validated_trees", "double_rank", "fit", "lag_report", "predict", "rank_ic", "search", "tune"]

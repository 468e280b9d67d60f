"""Spearman correlation of several columns with one, over all rows, without a sort of rows.

1. Rows are packed into blocks: one binary of order-keeping 64-bit keys a column.
2. A block sends its distinct y keys, with their counts, to ranges of keys; a range gives
   their average ranks back in the order sent.  A value that many rows hold is one entry
   a block, so no range grows with a frequent value.
3. A block sends the distinct keys of each column, with counts and the sums of y's ranks
   there; each range gives back its share of the sums of products.

Ranks are exact: ranges decide only who counts what.  NULL is missing, NaN is the largest
value, as in Spark's order.  The driver holds numbers a range and column, never rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import shared_table

MISSING = np.iinfo(np.int64).max
SAMPLES = 16


def _keys(column: pa.Array) -> np.ndarray:
    """Integers in the order of the doubles; equal doubles have equal keys."""
    x = column.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    bits = np.where(np.isnan(x), np.float64(np.nan).view(np.int64) & MISSING, bits)
    bits = np.where(bits < 0, bits ^ MISSING, bits)
    return np.where(np.array(column.is_valid()), bits, MISSING)


def _block(number: int, keys: np.ndarray) -> pa.RecordBatch:
    missing = keys[1:] == MISSING
    sample: list[int | None] = []
    for k in keys:
        held = k[k != MISSING]
        sample += held[np.arange(SAMPLES) * len(held) // SAMPLES].tolist() if len(held) else [None] * SAMPLES
    nulls = [*missing.sum(axis=1).tolist(), int(missing.any(axis=0).sum())]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([keys.shape[1]], pa.int64()), pa.array([sample], pa.list_(pa.int64())), pa.array([nulls], pa.list_(pa.int64())), *[pa.array([k.tobytes()], pa.binary()) for k in keys]],
        ["block", "n", "sample", "nulls", *[f"c{i}" for i in range(len(keys))]],
    )


def _blocks(d: DataFrame, rows: int, width: int, values=None) -> DataFrame:
    """``d``'s double columns (``values``: what it makes of a batch), the first without NULL, as blocks of about ``rows`` rows."""

    def each(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                held.append(np.stack([_keys(c) for c in (values(part) if values else part.columns)]))
                size += part.num_rows
                if size >= rows:
                    yield _block(number, np.concatenate(held, axis=1))
                    number, held, size = number + 1, [], 0
        if size:
            yield _block(number, np.concatenate(held, axis=1))

    return shared_table(d.mapInArrow(each, "block long, n long, sample array<long>, nulls array<long>, " + ", ".join(f"c{i} binary" for i in range(width))), "rank-blocks")


def _sums(keys: np.ndarray, *weights: np.ndarray):
    """Distinct sorted keys, and by them the sums of the weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *[np.add.reduceat(w[order], at) if len(at) else w[:0] for w in weights]


def _messages(keys: np.ndarray, cuts: np.ndarray):
    """(range, slice) of sorted keys; ranges without one are left out."""
    if not len(keys):
        return
    of = np.searchsorted(cuts, keys, side="left")
    at = np.flatnonzero(np.diff(of, prepend=-1))
    for a, b in zip(at, [*at[1:], len(of)], strict=True):
        yield int(of[a]), slice(int(a), int(b))


def _column(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column's binaries in a row, and the number of each binary."""
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts), np.array([len(p) for p in parts])


def _local(counts: np.ndarray) -> np.ndarray:
    """Average ranks within a range."""
    return np.cumsum(counts) - (counts - 1) / 2


def _ties(counts: np.ndarray) -> float:
    c = counts.astype(float)
    return float((c * c * c - c).sum())


def _rank_y(table: pa.Table) -> pa.Table:
    keys, sizes = _column(table, "keys", np.int64)
    counts, _ = _column(table, "counts", np.int64)
    distinct, total = _sums(keys, counts)
    ranks, ends = _local(total)[np.searchsorted(distinct, keys)], np.cumsum(sizes)
    return pa.table(
        {
            "g": table.column("g"), "bucket": table.column("bucket"), "block": table.column("block"),
            "ranks": pa.array([ranks[e - k : e].tobytes() for e, k in zip(ends, sizes, strict=True)], pa.binary()),
            "n": pa.array([int(total.sum())] * len(sizes), pa.int64()), "ties": pa.array([_ties(total)] * len(sizes), pa.float64()),
        }
    )


def _products(table: pa.Table) -> pa.Table:
    keys, _ = _column(table, "keys", np.int64)
    counts, _ = _column(table, "counts", np.int64)
    sums, _ = _column(table, "sums", np.float64)
    _, total, s = _sums(keys, counts, sums)
    return pa.table(
        {"i": table.column("i")[:1], "bucket": table.column("bucket")[:1], "n": [int(total.sum())], "s": [float(s.sum())], "t": [float((s * _local(total)).sum())], "ties": [_ties(total)]},
        schema=pa.schema([("i", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("t", pa.float64()), ("ties", pa.float64())]),
    )


def spearman(df: DataFrame, y: str, columns: list[str], values=None, made: int | None = None, block_rows: int = 1 << 17, range_rows: int = 250_000) -> list[float]:
    """Spearman correlation of each column with y over all rows with both; NaN where there is none.

    ``values`` makes y and ``made`` columns from each Arrow batch of y and ``columns``, which then count instead.
    """
    n_columns = len(columns) if made is None else made
    width = n_columns + 1
    d = df.where(F.col(y).isNotNull()).select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([y, *columns])])
    blocks = _blocks(d, max(1, block_rows // width), width, values)
    rows = blocks.agg(F.sum("n")).first()[0]
    if not rows:
        return [math.nan] * n_columns
    parts = min(2000, max(1, -(-rows // range_rows)))
    cuts = {i: np.zeros(0, np.int64) for i in range(width)}
    if parts > 1:
        by = blocks.select(F.posexplode("sample").alias("at", "key")).groupBy(F.floor(F.col("at") / SAMPLES).alias("i"))
        for r in by.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], 10_000).alias("cuts")).collect():
            cuts[int(r["i"])] = np.unique(np.array(r["cuts"] or [], np.int64))
    nulls = {r["at"]: r["k"] for r in blocks.select(F.posexplode("nulls").alias("at", "k")).groupBy("at").agg(F.sum("k").alias("k")).collect()}
    # Columns that are missing in the same rows share y's ranks: -1 in no row, -2 in every row where any is.
    group = [-1 if not nulls[i] else -2 if nulls[i] == nulls[width - 1] else i for i in range(n_columns)]
    first = {g: i + 1 for i, g in reversed(list(enumerate(group)))}

    def y_keys(get, g: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.frombuffer(get("c0"), np.int64)
        held = np.frombuffer(get(f"c{first[g]}"), np.int64) != MISSING
        return own[held], held

    def send_y(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(batch.schema.get_field_index(c))[r].as_py()  # noqa: B023, E731  used at once
                for g in first:
                    own, _ = y_keys(get, g)
                    keys, counts = _sums(own, np.ones(len(own), np.int64))
                    found = list(_messages(keys, cuts[0]))
                    block = get("block")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([g] * len(found), pa.int32()), pa.array([b for b, _ in found], pa.int32()), pa.array([block] * len(found), pa.int64()),
                            pa.array([keys[s].tobytes() for _, s in found], pa.binary()), pa.array([counts[s].tobytes() for _, s in found], pa.binary()),
                        ],
                        ["g", "bucket", "block", "keys", "counts"],
                    )

    needed = ["block", "c0", *sorted({f"c{i}" for i in first.values()})]
    sent = blocks.select(*needed).mapInArrow(send_y, "g int, bucket int, block long, keys binary, counts binary")
    answers = shared_table(sent.groupBy("g", "bucket").applyInArrow(_rank_y, "g int, bucket int, block long, ranks binary, n long, ties double"), "rank-answers")
    n, ties, base = dict.fromkeys(first, 0), dict.fromkeys(first, 0.0), {}
    for r in sorted(answers.groupBy("g", "bucket").agg(F.first("n").alias("n"), F.first("ties").alias("ties")).collect(), key=lambda r: r["bucket"]):
        base[r["g"], r["bucket"]] = n[r["g"]]
        n[r["g"]] += r["n"]
        ties[r["g"]] += r["ties"]

    def send_columns(block: pa.Table, answer: pa.Table) -> pa.Table:
        get = lambda c: block.column(c)[0].as_py()
        found: dict[int, list[np.ndarray]] = {g: [] for g in first}
        for g, b, ranks in sorted(zip(answer.column("g").to_pylist(), answer.column("bucket").to_pylist(), answer.column("ranks").to_pylist(), strict=True)):
            found[g].append(np.frombuffer(ranks, np.float64) + (base[g, b] - (n[g] + 1) / 2))
        out: list[list] = [[], [], [], [], []]
        for g in first:
            if not found[g]:
                continue
            own, held = y_keys(get, g)
            ranks = np.concatenate(found[g])[np.unique(own, return_inverse=True)[1]]
            for i, other in enumerate(group):
                if other != g:
                    continue
                keys, counts, sums = _sums(np.frombuffer(get(f"c{i + 1}"), np.int64)[held], np.ones(len(own), np.int64), ranks)
                for b, s in _messages(keys, cuts[i + 1]):
                    for to, v in zip(out, (i, b, keys[s].tobytes(), counts[s].tobytes(), sums[s].tobytes()), strict=True):
                        to.append(v)
        return pa.table(out, schema=pa.schema([("i", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary())]))

    both = blocks.drop("n", "sample", "nulls").groupBy("block").cogroup(answers.select("block", "g", "bucket", "ranks").groupBy("block"))
    shares = both.applyInArrow(send_columns, "i int, bucket int, keys binary, counts binary, sums binary").groupBy("i", "bucket").applyInArrow(_products, "i int, bucket int, n long, s double, t double, ties double")
    cov, before, own_ties = [0.0] * n_columns, [0] * n_columns, [0.0] * n_columns
    for r in sorted(shares.collect(), key=lambda r: (r["i"], r["bucket"])):
        i = r["i"]
        cov[i] += r["t"] + (before[i] - (n[group[i]] + 1) / 2) * r["s"]
        before[i] += r["n"]
        own_ties[i] += r["ties"]
    out = []
    for i, g in enumerate(group):
        cubes = float(n[g]) ** 3 - n[g]
        spread = (cubes - ties[g]) / 12, (cubes - own_ties[i]) / 12
        out.append(cov[i] / math.sqrt(spread[0] * spread[1]) if n[g] > 1 and min(spread) > 1e-12 * cubes else math.nan)
    return out


__all__ = ["spearman"]

"""Sparse and dense features of whole texts, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, mix, pieces, word_hashes, word_spans

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


def bag(column: pa.Array, bits: int, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Row bounds and sorted distinct hashed features of each text: letter-and-digit words in
    lower case (A-Z), and the first ``prefixes`` bytes of the words that are longer."""
    text = Words(column)
    raw = _FOLD[text.raw]
    starts, ends, rows = word_spans(raw, text.offsets)
    keys = [(rows.astype(np.uint64) << U64(32)) | (word_hashes(raw, starts, ends) >> U64(64 - bits))]
    for n in prefixes:
        long = np.flatnonzero(ends - starts > n)
        h = mix(word_hashes(raw, starts[long], starts[long] + n) + U64(n))
        keys.append((rows[long].astype(np.uint64) << U64(32)) | (h >> U64(64 - bits)))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    bounds = np.searchsorted(key, np.arange(text.n_rows + 1, dtype=np.uint64) << U64(32))
    return bounds, (key & U64(0xFFFFFFFF)).astype(np.int32)


#: Classes of bytes whose share of a text is a statistic.
_CLASSES = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), b"#*$%&|<>", b"!?", b".,;:", b"|"]
DENSE = ["log_words", "log_chars", "word_length", "repeat_words", "dup_lines", "words_a_line", "top_word", *(f"share{k}" for k in range(len(_CLASSES))), "bias"]


def dense(column: pa.Array, n_chars: np.ndarray) -> np.ndarray:
    """Structure statistics (DENSE) of each text; ``n_chars`` is metadata and may hold nan."""
    w = Words(column)
    n = np.diff(w.bounds).astype(float)
    size = np.diff(w.offsets).astype(float)
    out = np.zeros((w.n_rows, len(DENSE)))
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.log1p(np.where(np.isfinite(n_chars), np.maximum(n_chars, 0), size))
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[w.offsets])
    chars = np.bincount(w.rows, weights=w.ends - w.starts, minlength=w.n_rows)
    out[:, 2] = np.log1p(chars / np.maximum(n, 1))
    key = (w.rows.astype(np.uint64) << U64(40)) | (w.hashes >> U64(24))
    uniq, counts = np.unique(key, return_counts=True)
    of = (uniq >> U64(40)).astype(np.int64)
    out[:, 3] = 1 - np.bincount(of, minlength=w.n_rows) / np.maximum(n, 1)
    top = np.zeros(w.n_rows)
    np.maximum.at(top, of, counts)
    out[:, 6] = top / np.maximum(n, 1)
    # Lines: as words between line feeds.
    newline = w.raw == 10
    raw = np.where(newline, np.uint8(32), np.where((w.raw == 32), np.uint8(1), w.raw))
    starts, ends, rows = word_spans(raw, w.offsets)
    lines = np.bincount(rows, minlength=w.n_rows)
    lkey = np.unique((rows.astype(np.uint64) << U64(40)) | (word_hashes(raw, starts, ends) >> U64(24)))
    out[:, 4] = 1 - np.bincount((lkey >> U64(40)).astype(np.int64), minlength=w.n_rows) / np.maximum(lines, 1)
    out[:, 5] = np.log1p(n / np.maximum(lines, 1))
    for k, members in enumerate(_CLASSES):
        flag = np.zeros(256, dtype=bool)
        flag[list(members)] = True
        out[:, 7 + k] = total(flag[w.raw]) / np.maximum(size, 1)
    out[:, -1] = 1
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Texts of at most ``most`` labelled rows: those whose ids hash lowest.

    ``labels``: doc_id and label columns, rows to learn from only.  The ids are few by
    the bound, so they are broadcast.
    """
    chosen = labels.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", *[c for c in labels.columns if c != "doc_id"]).limit(most)
    found = docs.select(*[c for c in ("doc_id", "text", "n_chars") if c in docs.columns]).join(F.broadcast(chosen.distinct()), "doc_id")
    # One row a label: of rows that share an id the first by text, so the sample stays within the bound.
    rest = [c for c in found.columns if c not in chosen.columns]
    return found.groupBy(*chosen.columns).agg(F.min(F.struct(*rest)).alias("_r")).select(*chosen.columns, "_r.*")


def collect_features(sample: DataFrame, label: str, bits: int, prefixes: tuple[int, ...] = (), with_dense: bool = True):
    """(ids, labels, row bounds, features, dense matrix) of a bounded sample, in id order."""

    def extract(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                text = part.column("text")
                bounds, keys = bag(text, bits, prefixes)
                d = dense(text, part.column("n_chars").to_numpy(zero_copy_only=False).astype(float)) if with_dense else np.zeros((len(part), 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column(label).cast(pa.int32()), pa.array([keys[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()), pa.array([x.tobytes() for x in d], pa.binary())],
                    ["doc_id", "label", "keys", "dense"],
                )

    cols = ["doc_id", "text", *(["n_chars"] if with_dense else []), label]
    rows = sample.select(*cols).mapInArrow(extract, "doc_id long, label int, keys binary, dense binary").toPandas()
    rows = rows.sort_values(["doc_id", "label", "keys"], ignore_index=True)
    parts = [np.frombuffer(x, np.int32) for x in rows["keys"]]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
    keys = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    d = np.array([np.frombuffer(x) for x in rows["dense"]]) if len(rows) else np.zeros((0, 1))
    return rows["doc_id"].to_numpy(), rows["label"].to_numpy(), bounds, keys, d


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] per row; empty rows give 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
    return total[bounds[1:]] - total[bounds[:-1]]

"""Shared pieces of the corpus operators.

* ``words of a batch``: a whole Arrow batch of texts is tokenised at once with
  numpy; no Python object is made for a word.
* ``blocks``: documents dealt into blocks of bounded size by a hash of their id.
  Operators that look up corpus-wide facts send one compact message per (block,
  hash bucket) instead of one row per word, so a key that every document holds
  costs one entry per block, never one per document.
* ``materialise``: cuts lineage with a table in the shared checkpoint folder.
"""

from __future__ import annotations

import ctypes
import math
import sys
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: The separators of the words `[^\x20\x09-\x0D]+`.
SPACES = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="panelforge-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame) -> DataFrame:
    """``df``, the result of an aggregation, for writing: eight of its partitions a file, but four files a core at least.

    On a file system without native calls each part file costs several processes forked from the executor.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, parts // 8))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def crc_mod(ids, mod: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % mod for x in ids], dtype=np.int64)


# -- words ---------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of ``x``."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[k] = np.cumprod(a)
    return _POWERS["p"], _POWERS["q"]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and row of each word."""
    space = _SPACE[raw]
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[offsets[:-1]] = True
    inside = ~space
    first = inside & (begins[:-1] | np.concatenate(([True], space[:-1])))
    last = inside & (np.concatenate((begins[1:-1], [True])) | np.concatenate((space[1:], [True])))
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, read off running sums of ``span`` bytes and the last word's rest."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + span)))
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        part = raw[starts[i] : ends[j - 1]]
        p, q = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * p[: len(part)], out=total[1:])
        out[i:j] = mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64))
        i = j
    return out


def windows(words: np.ndarray, rows: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words within a row, and the position of its first word."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(m, seed * 2 + 1, dtype=np.uint64)
    for k in range(n):
        h *= U64(0xD6E8FEB86659FD93)
        h += words[k : k + m]
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(h[at]), at


def give_back() -> None:
    """Return freed memory to the system: Python workers live on and would keep their peak."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """Slices of a batch with about ``most`` bytes of text each; a longer text stands alone."""
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    give_back()


class Words:
    """The words of the texts in a string column."""

    def __init__(self, column, lower: bool = False):
        raw, self.offsets = text_buffers(column)
        self.raw = _LOWER[raw] if lower else raw
        self.n_rows = len(self.offsets) - 1
        self.starts, self.ends, self.rows = word_spans(self.raw, self.offsets)
        self.hashes = word_hashes(self.raw, self.starts, self.ends)
        #: words[bounds[i] : bounds[i + 1]] are those of row i
        self.bounds = np.searchsorted(self.rows, np.arange(self.n_rows + 1))

    def __len__(self) -> int:
        return len(self.starts)


# -- blocks and messages ---------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Sorted or small 64-bit integers as the byte planes of their differences: what follows compresses them."""
    if not len(values):
        return b""
    steps = np.diff(values.astype(np.uint64), prepend=U64(0))
    planes = steps.view(np.uint8).reshape(len(steps), 8).T
    width = 8
    while width > 1 and not planes[width - 1].any():
        width -= 1
    return bytes([width]) + planes[:width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width, n = data[0], (len(data) - 1) // data[0]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, n).T
    return np.cumsum(out.view(np.uint64).ravel())


def pack_small(values: np.ndarray) -> bytes:
    """Small non-negative integers as byte planes, in the order given."""
    if not len(values):
        return b""
    planes = values.astype(np.uint64).view(np.uint8).reshape(len(values), 8).T
    width = 8
    while width > 1 and not planes[width - 1].any():
        width -= 1
    return bytes([width]) + planes[:width].tobytes()


def unpack_small(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width, n = data[0], (len(data) - 1) // data[0]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, n).T
    return out.view(np.uint64).ravel()


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one scan of that column, one row back."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def split_count(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def grown(each: int, total: int, most: int = 16, parts: int = 1 << 16) -> int:
    """The size of a part: ``each``, or what makes ``parts`` of the total, up to ``most`` times as much."""
    return min(each * most, max(each, total // parts))


def bucket_bits(entries: int, each: int = 1 << 20) -> int:
    """Buckets, as a power of two, of about ``each`` entries, eight times as many where there are very many."""
    return max(3, math.ceil(math.log2(max(1, entries) / grown(each, entries, 8, 1 << 14)))) if entries else 3


def by_bucket(hashes: np.ndarray, bits: int):
    """(bucket, slice) of sorted hashes by their top bits; empty buckets are left out."""
    if not len(hashes):
        return
    of = (hashes >> U64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.diff(of, prepend=-1))
    for a, b in zip(at, [*at[1:], len(of)], strict=True):
        yield int(of[a]), slice(int(a), int(b))


def _blocked(docs: DataFrame, block: Column) -> DataFrame:
    # As many partitions as other exchanges have: what is joined by block is dealt alike.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.withColumn("_block", block.cast("int")).repartition(parts, "_block")


def in_blocks(docs: DataFrame, n_blocks: int, key: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``_block`` by a hash of the key, all rows of a block in one
    partition; two uses of the result in one query share one exchange."""
    return _blocked(docs, F.pmod(F.xxhash64(F.col(key), F.lit(77)), F.lit(n_blocks)))


def in_ranges(docs: DataFrame, n_blocks: int, key: str = "doc_id", coarse: int = 4096) -> DataFrame:
    """The same with blocks that are ranges of the key: a key of an earlier block is smaller.

    Up to ``coarse`` ranges lie between quantiles of the key, which the driver holds; for
    more blocks each of them is cut into equal steps.  Null keys stand in the first block.
    """
    if n_blocks < 2:
        return _blocked(docs, F.lit(0))
    k = F.col(key).cast("double")
    parts = min(n_blocks, coarse)
    fine = math.ceil(n_blocks / parts)
    at = docs.select(k.alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], min(0.05, 0.1 / parts))
    edges = sorted(set(at))
    if not edges:
        return _blocked(docs, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    cut = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_key", outputCol="_range")
    found = cut.transform(docs.withColumn("_key", F.coalesce(k, F.lit(-1e300))))
    block = F.col("_range")
    if fine > 1:
        ends = docs.agg(F.min(k), F.max(k)).first()
        low, high = F.lit([min(ends[0], edges[0]), *edges]), F.lit([*edges, max(ends[1], edges[-1]) + 1.0])
        i = block.cast("int") + 1
        step = F.try_divide(F.col("_key") - F.element_at(low, i), F.element_at(high, i) - F.element_at(low, i))
        block = block * fine + F.least(F.greatest(F.floor(F.coalesce(step, F.lit(0.0)) * fine), F.lit(0)), F.lit(fine - 1))
    return _blocked(found.withColumn("_range", block).drop("_key"), F.col("_range")).drop("_range")

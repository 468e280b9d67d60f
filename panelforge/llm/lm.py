"""LM scoring: a trigram model by deleted interpolation.

P(w | u v) = a3 c(u v w) / c(u v) + a2 c(v w) / c(v) + a1 c(w) / N + a0 / (V + 1), with
weights that depend on the frequency of the history: one set for each power of two of
c(u v), or of c(v) where u v is unseen.  A tenth of the training documents is deleted
from the counts; expectation-maximisation finds the weights under which the remaining
counts predict the deleted part best.  Scores use the counts of all training documents
with those weights.

All counts are of the whole corpus.  Documents are packed into compressed blocks where
they are read; a block sends its distinct tokens, then its bigrams, then its trigrams,
once each with their numbers, to hash buckets and gets the corpus counts back in the
order sent.  A token that stands in every document is one entry a block.  An n-gram with
a part that occurs once in the whole corpus occurs once itself, so its counts are known
without being sent.  EM reads a histogram over (history bucket, three estimates) with
four steps an octave, merged in two levels: its size is bounded, whatever the corpus.
The whole is one query; texts are shuffled once, compressed.

Tokens: lower case A-Z words, then one end, counted as a token.  A document's first
token has the start of a document as its whole history.

N-grams are told apart by 64-bit hashes, in small corpora by as many bits as make one
equal pair in the whole corpus unlikely.

Defined results: null text is an empty one and has the end alone; a null doc_id counts
as training; repeated rows are counted as often as they occur; a very long text is a
block of its own; without training tokens N and V are 0, base scores 0 and scores those
of the uniform part; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, bucket_bits, by_bucket, give_back, mix, pack, pack_small, pieces, text_bytes, unpack, unpack_small

END, START = U64(0x51ED270B9F3C8A11), U64(0x2545F4914F6CDD1D)
PLANES = ("c", "t", "d", "h", "x")  # counts in training, in all, deleted; of deleted ones the history's count and codes
MESSAGE = "_bucket int, _block long, hashes binary, " + ", ".join(f"{p} binary" for p in PLANES)
ANSWER = "_block long, kind int, bucket int, data binary"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
TOTALS, WEIGHTS, SUMS, HISTOGRAM = 0, 10, 11, 12  # kinds 1 to 3 are the counts of n-grams
STEPS, LEVELS, MERGERS = 4, 40, 32  # histogram steps an octave, history buckets of an order, first-level merges


def _crc(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) for x in ids], dtype=np.int64)


# -- blocks ----------------------------------------------------------------------


def packed_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(_block, data): documents as read, in blocks of about ``block_bytes`` of text."""

    def each(batches):
        held, size, number = [], 0, 0

        def flush():
            nonlocal held, size, number
            part = held[0].column("_part")[0].as_py()
            table = pa.Table.from_batches([b.select(["doc_id", "text"]) for b in held])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.combine_chunks())
            block = (part << 32) + number
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["_block", "data"])

        for batch in batches:
            for part in pieces(batch, "text"):
                held.append(part)
                size += part.nbytes
                if size >= block_bytes:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.spark_partition_id().alias("_part"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "_block long, data binary")


class Tokens:
    """The token stream of a block's documents."""

    def __init__(self, blobs: pa.Table, mask: int):
        tables = [pa.ipc.open_stream(pa.py_buffer(x)).read_all() for x in blobs.column("data").to_pylist()]
        table = pa.concat_tables(tables).combine_chunks()
        self.ids, self.mask = table.column("doc_id"), U64(mask)
        text = table.column("text")
        w = Words(text.combine_chunks() if text.num_chunks != 1 else text.chunk(0), lower=True)
        n = w.n_rows
        self.sizes = np.diff(w.bounds) + 1
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        self.token = np.full(self.bounds[-1], END, dtype=np.uint64)
        self.token[np.arange(len(w)) + w.rows] = w.hashes
        crc = _crc(self.ids.to_pylist())
        self.held_out = crc % 5 == 1
        deleted = ~self.held_out & (crc // 5 % 10 == 0)
        rows = np.repeat(np.arange(n), self.sizes)
        self.first = np.zeros(len(self.token), dtype=bool)
        self.first[self.bounds[:-1]] = True
        self.train_at, self.gone_at = ~self.held_out[rows], deleted[rows]
        # Sorted distinct tokens; the start of a document is one, counted by documents.
        self.types, at = np.unique(np.concatenate((self.token, np.full(n, START, np.uint64))), return_inverse=True)
        self.at, self.start = at[: len(self.token)], int(at[-1])
        self.before = np.empty_like(self.at)
        self.before[1:] = self.at[:-1]
        self.before[self.first] = self.start
        count = lambda mine, docs: np.bincount(at, np.concatenate((mine, docs)).astype(float), len(self.types)).astype(np.int64)
        self.local = (count(self.train_at, ~self.held_out), count(np.ones(len(rows)), np.ones(n)), count(self.gone_at, deleted))

    def grams(self, hashes: np.ndarray, some: np.ndarray):
        """Sorted distinct hashes of the positions ``some``, one position of each, the type of each position, and local counts."""
        types, first, of = np.unique(hashes & self.mask, return_index=True, return_inverse=True)
        count = lambda flags: np.bincount(of, flags[some].astype(float), len(types)).astype(np.int64)
        return types, some[first], of, (count(self.train_at), np.bincount(of, minlength=len(types)), count(self.gone_at))

    def bigrams(self, one: Counts):
        """Every position's bigram: (type counts known here, candidates' place among types, type of each position)."""
        h = mix(mix(self.types[self.before]) * U64(0xD6E8FEB86659FD93) + self.token)
        types, first, of, local = self.grams(h, np.arange(len(self.token)))
        asked = one.many[self.before[first]] & one.many[self.at[first]]
        return types, first, of, local, asked, h

    def trigrams(self, two: Counts, of2: np.ndarray, h2: np.ndarray):
        """The same for all but the first token of each document."""
        some = np.flatnonzero(~self.first)
        h = mix(mix(h2[some - 1] ^ U64(0x9E3779B97F4A7C15)) * U64(0xD6E8FEB86659FD93) + self.token[some])
        types, first, of, local = self.grams(h, some)
        asked = two.many[of2[first - 1]] & two.many[of2[first]]
        return types, first, of, local, asked, some


class Counts:
    """Corpus counts of a block's types: those asked for from the answers, the others as known here.

    ``many``: whether a type occurs more than once; ``d`` is known of types that deleted
    documents of the block hold, which is where it is used.
    """

    def __init__(self, local, asked: np.ndarray | slice, answers: list[bytes]):
        c, t, d = local
        self.c, self.many, self.d = c.copy(), t > 1, d.copy()
        parts = [unsized(x) for x in answers]
        if not parts:
            return
        here = np.arange(len(c))[asked]
        sizes = [len(unpack_small(x[0])) for x in parts]
        self.c[here] = np.concatenate([unpack_small(x[0]) for x in parts])
        if len(parts[0]) > 1:
            self.many[here] = np.concatenate([np.unpackbits(np.frombuffer(x[1], np.uint8), count=n) for x, n in zip(parts, sizes, strict=True)])
            self.d[here[d[here] > 0]] = np.concatenate([unpack_small(x[2]) for x in parts])

    @property
    def kept(self) -> np.ndarray:
        return self.c - self.d


# -- messages --------------------------------------------------------------------


def squeeze(data: bytes) -> bytes:
    """Compressed where that is smaller, behind its size (0: as it is)."""
    small = pa.compress(data, codec="zstd", asbytes=True) if len(data) > 64 else data
    return len(data).to_bytes(4, "little") + small if len(small) < len(data) else bytes(4) + data


def loosen(data: bytes) -> bytes:
    size = int.from_bytes(data[:4], "little")
    return pa.decompress(data[4:], size, codec="zstd", asbytes=True) if size else data[4:]


def _sized(*parts: bytes) -> bytes:
    return b"".join([len(x).to_bytes(8, "little") + x for x in map(squeeze, parts)])


def unsized(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(loosen(data[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def _messages(block: int, bits: int, hashes, counts, h=None, x=None, extra: list[tuple] = ()) -> pa.Table:
    rows: list[tuple] = list(extra)
    for bucket, s in by_bucket(hashes, bits):
        some = np.flatnonzero(counts[2][s]) + s.start
        rows.append((bucket, block, *map(squeeze, (pack(hashes[s]), *[pack_small(v[s]) for v in counts], *[b"" if v is None else pack_small(v[some]) for v in (h, x)]))))
    cols = list(zip(*rows, strict=True)) if rows else [()] * 8
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.table({n: pa.array(list(v), k) for n, v, k in zip(("_bucket", "_block", "hashes", *PLANES), cols, kinds, strict=True)})


def _answers(kind: int, table: pa.Table, data: list[bytes], extra: tuple[int, bytes] | None = None) -> pa.Table:
    bucket = table.column("_bucket")[0].as_py()
    blocks = table.column("_block").to_pylist()
    kinds = [kind] * len(blocks)
    if extra is not None:
        blocks, kinds, data = [*blocks, -1 - bucket], [*kinds, extra[0]], [*data, extra[1]]
    return pa.table({"_block": pa.array(blocks, pa.int64()), "kind": pa.array(kinds, pa.int32()), "bucket": pa.array([bucket] * len(blocks), pa.int32()), "data": pa.array(data, pa.binary())})


def pack_histogram(keys: np.ndarray, weight: np.ndarray) -> bytes:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return _sized(pack(distinct.astype(np.uint64)), pack_small(np.bincount(inverse, weight.astype(float), len(distinct))))


def unpack_histograms(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, weight = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for x in data:
        k, w = unsized(x)
        keys.append(unpack(k))
        weight.append(unpack_small(w))
    return np.concatenate(keys).astype(np.int64), np.concatenate(weight).astype(np.int64)


def _count(kind: int):
    """Sums the messages of a bucket up and answers each in its own order."""

    def each(table: pa.Table) -> pa.Table:
        bucket = table.column("_bucket")[0].as_py()
        if bucket < 0:  # histograms of blocks
            merged = pack_histogram(*unpack_histograms(table.column("hashes").to_pylist()))
            one = pa.table({"_bucket": pa.array([bucket], pa.int32()), "_block": pa.array([bucket], pa.int64())})
            return _answers(HISTOGRAM, one, [merged])
        parts = [unpack(loosen(x)) for x in table.column("hashes").to_pylist()]
        planes = [np.concatenate([unpack_small(loosen(x)) for x in table.column(p).to_pylist()]).astype(np.int64) for p in PLANES]
        types, at = np.unique(np.concatenate(parts), return_inverse=True)
        c, t, d = (np.bincount(at, x.astype(float), len(types)).astype(np.int64) for x in planes[:3])
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        data = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            mine = at[a:b]
            rest = (np.packbits(t[mine] > 1).tobytes(), pack_small(d[mine[planes[2][a:b] > 0]])) if kind < 3 else ()
            data.append(_sized(pack_small(c[mine]), *rest))
        if kind == 1:
            word = types != START
            return _answers(kind, table, data, (SUMS, np.array([c[word].sum(), d[word].sum(), (c[word] > 0).sum()], dtype="<i8").tobytes()))
        if kind == 2:
            return _answers(kind, table, data)
        # What the kept counts say of each trigram of the deleted part.
        some, first = np.unique(at[np.flatnonzero(planes[2])], return_index=True)
        keys = planes[4][first] | (code((c - d)[some], planes[3][first]) << 24)
        return _answers(kind, table, data, (HISTOGRAM, pack_histogram(keys, d[some])))

    return each


def code(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A share as a number below 256: 0 for none, else by ``STEPS`` an octave."""
    share = count / np.maximum(of, 1)
    some = (count > 0) & (of > 0)
    return np.where(some, 1 + np.minimum(np.round(-STEPS * np.log2(np.where(some, np.minimum(share, 1), 1))), 254), 0).astype(np.int64)


def uncode(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 2.0 ** (-(codes - 1) / STEPS), 0.0)


def level(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Frequency bucket of a history: by its own count, or by its last word's where it is unseen."""
    octave = lambda x: np.minimum(np.frexp(x.astype(float))[1], LEVELS - 1)
    return np.where(two > 0, octave(two), LEVELS + octave(one))


# -- expectation-maximisation ------------------------------------------------------


def expectation_maximisation(keys: np.ndarray, weight: np.ndarray, n_types: int, rounds: int = 60) -> np.ndarray:
    """Weights (trigram, bigram, unigram, uniform) by history bucket, from the histogram of the deleted part."""
    of = keys & 255
    p = np.stack([uncode(keys >> 24 & 255), uncode(keys >> 16 & 255), uncode(keys >> 8 & 255), np.full(len(keys), 1 / (n_types + 1))], axis=1)
    may = np.ones((2 * LEVELS, 4), dtype=bool)
    may[LEVELS:, 0] = False
    may[LEVELS, 1] = False

    def solve(mine: np.ndarray, a: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        a = np.where(allowed, np.maximum(a, 1e-6), 0)
        a = a / a.sum()
        for _ in range(rounds if len(mine) else 0):
            share = p[mine] * a
            share *= (weight[mine] / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            a = share.sum(axis=0) / max(share.sum(), 1e-300)
        a = np.where(allowed, np.maximum(a, 1e-6), 0)
        return a / a.sum()

    overall = solve(np.arange(len(keys)), np.full(4, 0.25), may[0])
    return np.array([solve(np.flatnonzero(of == k), overall, may[k]) for k in range(2 * LEVELS)])


def _only(kind: int):
    def each(batches):
        for batch in batches:
            yield batch.filter(pa.array(np.array(batch.column("kind").to_numpy(zero_copy_only=False) == kind)))

    return each


def _block_names(batches):
    """The blocks of a partition; all answers to a block are in one."""
    seen: set[int] = set()
    for batch in batches:
        new = [x for x in dict.fromkeys(batch.column("_block").to_pylist()) if x >= 0 and x not in seen]
        seen.update(new)
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([0] * len(new), pa.int32())], ["_block", "one"])


def _totals(table: pa.Table) -> pa.Table:
    s = sum((np.frombuffer(x, "<i8") for x in table.column("data").to_pylist()), np.zeros(3, "<i8"))
    return pa.table({"one": pa.array([0], pa.int32()), "data": pa.array([s.astype("<i8").tobytes()], pa.binary())})


def _merge_histograms(table: pa.Table) -> pa.Table:
    return pa.table({"data": pa.array([pack_histogram(*unpack_histograms(table.column("data").to_pylist()))], pa.binary())})


def _learn(histograms: pa.Table, totals: pa.Table) -> pa.Table:
    keys, weight = unpack_histograms(histograms.column("data").to_pylist())
    keys, inverse = np.unique(keys, return_inverse=True)
    types = int(np.frombuffer(totals.column("data")[0].as_py(), "<i8")[2]) if totals.num_rows else 0
    weights = expectation_maximisation(keys, np.bincount(inverse, weight.astype(float), len(keys)), types)
    return pa.table({"one": pa.array([0], pa.int32()), "data": pa.array([weights.tobytes()], pa.binary())})


# -- the rounds ------------------------------------------------------------------


def _send_tokens(bits: int, mask: int):
    def each(blobs: pa.Table) -> pa.Table:
        t = Tokens(blobs, mask)
        return _messages(blobs.column("_block")[0].as_py(), bits, t.types, t.local)

    return each


def _read(answers: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for kind, _, data in sorted(zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True), key=lambda x: x[:2]):
        out.setdefault(kind, []).append(data)
    return out


NO_MESSAGE = (0, 8, np.zeros(0, np.uint64), (np.zeros(0, np.int64),) * 3)


def _send_bigrams(bits: int, mask: int):
    def each(blobs: pa.Table, answers: pa.Table) -> pa.Table:
        if not blobs.num_rows:
            return _messages(*NO_MESSAGE)
        t, found = Tokens(blobs, mask), _read(answers)
        types, _, _, local, asked, _ = t.bigrams(Counts(t.local, slice(None), found[1]))
        return _messages(blobs.column("_block")[0].as_py(), bits, types[asked], [x[asked] for x in local])

    return each


def _send_trigrams(bits: int, mask: int):
    def each(blobs: pa.Table, answers: pa.Table) -> pa.Table:
        if not blobs.num_rows:
            return _messages(*NO_MESSAGE)
        give_back()
        t, found, block = Tokens(blobs, mask), _read(answers), blobs.column("_block")[0].as_py()
        one = Counts(t.local, slice(None), found[1])
        _, _, of2, local2, asked2, h2 = t.bigrams(one)
        two = Counts(local2, asked2, found.get(2, []))
        types, first, _, local, asked, _ = t.trigrams(two, of2, h2)
        n = np.frombuffer(found[TOTALS][0], "<i8")
        history = two.kept[of2[first - 1]]
        last = one.kept[t.before[first]]
        own = one.kept[t.at[first]]
        codes = level(history, last) | (code(own, np.full(len(own), n[0] - n[1])) << 8) | (code(two.kept[of2[first]], last) << 16)
        alone = ~asked & (local[2] > 0)  # deleted ones that occur nowhere else
        extra = [(-1 - block % MERGERS, block, pack_histogram(codes[alone], local[2][alone]), *[b""] * 5)] if alone.any() else []
        return _messages(block, bits, types[asked], [x[asked] for x in local], history[asked], codes[asked], extra)

    return each


def _score(mask: int):
    def each(blobs: pa.Table, answers: pa.Table) -> pa.Table:
        if not blobs.num_rows:
            return pa.Table.from_batches([], schema=ARROW)
        give_back()
        t, found = Tokens(blobs, mask), _read(answers)
        one = Counts(t.local, slice(None), found[1])
        _, _, of2, local2, asked2, h2 = t.bigrams(one)
        two = Counts(local2, asked2, found.get(2, []))
        _, _, of3, local3, asked3, some = t.trigrams(two, of2, h2)
        three = Counts(local3, asked3, found.get(3, []))
        n, _, types = (int(x) for x in np.frombuffer(found[TOTALS][0], "<i8"))
        weights = np.frombuffer(found[WEIGHTS][0]).reshape(2 * LEVELS, 4)
        own, last = one.c[t.at], one.c[t.before]
        # A document's first token: history and last word are both its start.
        pair, triple, history = two.c[of2], two.c[of2].copy(), last.copy()
        triple[some], history[some] = three.c[of3], two.c[of2[some - 1]]
        a = weights[level(history, last)]
        p = a[:, 0] * triple / np.maximum(history, 1) + a[:, 1] * pair / np.maximum(last, 1) + a[:, 2] * own / max(n, 1) + a[:, 3] / (types + 1)
        total = lambda x: np.add.reduceat(x, t.bounds[:-1])
        base = np.log10((own + 0.5) / (n + 0.5 * (types + 1)))
        cols = [t.ids.combine_chunks() if isinstance(t.ids, pa.ChunkedArray) else t.ids, pa.array(t.held_out), t.sizes.astype(np.int64), total((own > 0).astype(np.int64)), np.full(len(t.sizes), n, np.int64), total(base), total(np.log10(p))]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], schema=ARROW)

    return each


def hash_mask(words: int) -> int:
    """As many leading bits of a hash as make an equal pair among ``words`` n-grams unlikely, 64 at most."""
    bits = min(64, 2 * math.ceil(math.log2(max(words, 2))) + 1)
    return ((1 << bits) - 1) << (64 - bits)


def lm_scores(docs: DataFrame, block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    size = text_bytes(docs)
    mask, parts = hash_mask(size // 5), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # What is dealt by block once is read from there by all that needs it.
    by_block = lambda df: df.repartition(parts, "_block")
    ask = lambda sent, kind: by_block(sent.groupBy("_bucket").applyInArrow(_count(kind), ANSWER))
    blocks = by_block(packed_blocks(docs, block_bytes))
    answered = lambda answers, f: blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(f, MESSAGE)

    ones = ask(blocks.groupBy("_block").applyInArrow(_send_tokens(bucket_bits(size // 24), mask), MESSAGE), 1)
    names = ones.mapInArrow(_block_names, "_block long, one int")
    totals = ones.mapInArrow(_only(SUMS), ANSWER).groupBy(F.lit(0).alias("one")).applyInArrow(_totals, "one int, data binary")
    to_all = lambda row, kind: by_block(names.join(F.broadcast(row), "one").select("_block", F.lit(kind).alias("kind"), F.lit(0).alias("bucket"), "data"))  # noqa: E731  one row
    known = ones.unionByName(to_all(totals, TOTALS))
    twos = ask(answered(ones, _send_bigrams(bucket_bits(size // 8), mask)), 2)
    threes = ask(answered(known.unionByName(twos), _send_trigrams(bucket_bits(size // 10), mask)), 3)
    merged = threes.mapInArrow(_only(HISTOGRAM), ANSWER).groupBy(F.pmod("bucket", F.lit(MERGERS)).alias("k")).applyInArrow(_merge_histograms, "data binary")
    weights = merged.groupBy(F.lit(0).alias("one")).cogroup(totals.groupBy("one")).applyInArrow(_learn, "one int, data binary")
    answers = known.unionByName(twos).unionByName(threes).unionByName(to_all(weights, WEIGHTS))
    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_score(mask), SCHEMA)

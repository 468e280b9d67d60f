"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Word counts of the whole corpus for the benchmark's words (partial counts per task),
   in one pass for all of the benchmark.
2. Each position of a test item gets the shortest n-gram (2 to 8 words) expected at
   most ``expected`` times in a corpus of that size if words were independent: seeds
   stay rare as the corpus grows, and copies of an item don't make its own seeds common,
   as they would if n-grams were counted.  Beside these each item has its rarest word pair
   among every third position, from each of the first three, however often it is expected:
   an item of frequent words has seeds in a corpus of any size, and a copy with every
   third word replaced keeps one.
3. Every text is scanned for the seeds; each hit fixes an item and a diagonal.
4. The words around the diagonal are aligned locally with the item (match 2, mismatch
   -1, gap -1).  ``score`` is the best sum over that of a full copy, ``passage_score`` the
   same sum over that of a full copy of the passage.  Substitutions, insertions and
   deletions only lower them.  A passage counts with a score of ``threshold``, or with a
   passage score of ``threshold`` and a sum of at least ``passage`` matching words: part
   of a long item is a leak too.  Items of fewer than five words count as full copies only.

The benchmark is the stated query set: it is taken in blocks of at most ``block_bytes``
of text, which is what is collected and sent to the tasks; every block passes over all
texts.  Nothing of the documents is shuffled, and hot passages stay in their own rows.

Words are runs of letters, digits and non-ASCII bytes, A-Z in lower case.

Defined results: null texts and items have no words; items of fewer than ``min_words``
words never match (one word is no passage); repeated items are reported each; repeated
documents, and rows that share an id, are reported once per row; a very long text is
scanned whole; among equal scores the first passage is reported; other columns keep
their values, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, mix, pieces, split_count, text_bytes, word_hashes, word_spans
from .features import _FOLD

SCHEMA = "doc_id long, item_id long, score double, passage_score double, start_word long, end_word long"
COLUMNS = ["doc_id", "item_id", "score", "passage_score", "start_word", "end_word"]
SHORT = 5
MATCH, MISS, GAP, LONGEST = 2, 1, 1, 8


def folded(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each word of a string column, and the bounds of the rows."""
    w = Words(column)
    raw = _FOLD[w.raw]
    starts, ends, rows = word_spans(raw, w.offsets)
    return word_hashes(raw, starts, ends), rows, np.searchsorted(rows, np.arange(w.n_rows + 1))


@dataclass
class Items:
    """A block of test items, as indices of their words in the block's vocabulary."""

    ids: np.ndarray
    vocabulary: np.ndarray  # sorted hashes
    words: list[np.ndarray]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        return lookup(self.vocabulary, hashes)


def load_items(benchmark: DataFrame, min_words: int) -> Items:
    rows = sorted((int(r["item_id"]), r["text"]) for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").collect())
    h, _, bounds = folded(pa.array([t for _, t in rows], pa.string()))
    vocabulary = np.unique(h)
    at = np.searchsorted(vocabulary, h)
    keep = [i for i in range(len(rows)) if bounds[i + 1] - bounds[i] >= min_words]
    return Items(np.array([rows[i][0] for i in keep], np.int64), vocabulary, [at[bounds[i] : bounds[i + 1]] for i in keep])


def lookup(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places among sorted hashes, -1 where they are not."""
    if not len(vocabulary):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1).astype(np.int64)


def count_words(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Corpus count of each word of the sorted vocabulary, and of all words."""

    def each(batches):
        counts, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                h = folded(part.column("text"))[0]
                at = lookup(vocabulary, h)
                counts += np.bincount(at[at >= 0], minlength=len(counts))
                total += len(h)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], total))], ["word", "n"])

    rows = docs.select("text").mapInArrow(each, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(len(vocabulary), np.int64), 0
    for r in rows:
        if r["word"] < 0:
            total = r["n"]
        else:
            counts[r["word"]] = r["n"]
    return counts, total


@dataclass
class Seeds:
    lengths: list[int]
    keys: list[np.ndarray]  # per length: sorted distinct keys
    bounds: list[np.ndarray]  # per key: its places
    item: list[np.ndarray]
    place: list[np.ndarray]
    pairs: np.ndarray  # sorted keys of the first two words of all seeds


def _key(at: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(pos), n, np.uint64)
    for k in range(n):
        h = mix(h * U64(0x9E3779B97F4A7C15) + at[pos + k].astype(np.uint64))
    return h


def make_seeds(items: Items, counts: np.ndarray, total: int, expected: float) -> Seeds:
    log_p = np.log((counts + 0.5) / (total + 0.5 * (len(counts) + 1)))
    found: dict[int, list[tuple[np.uint64, int, int]]] = {}
    pairs = []
    for i, at in enumerate(items.words):
        pair = log_p[at[:-1]] + log_p[at[1:]]
        always = {k + 3 * int(pair[k::3].argmin()) for k in range(min(3, len(pair)))}
        for pos in range(len(at) - 1):
            most = min(LONGEST, len(at) - pos)
            n = next((n for n in range(2, most + 1) if np.log(max(total, 1)) + log_p[at[pos : pos + n]].sum() <= np.log(expected)), most)
            if n < most or n == LONGEST or np.log(max(total, 1)) + log_p[at[pos : pos + n]].sum() <= np.log(expected):
                found.setdefault(n, []).append((_key(at, np.array([pos]), n)[0], i, pos))
                pairs.append(_key(at, np.array([pos]), 2)[0])
            else:
                n = 0
            if pos in always and n != 2:
                found.setdefault(2, []).append((_key(at, np.array([pos]), 2)[0], i, pos))
                pairs.append(found[2][-1][0])
    out = Seeds([], [], [], [], [], np.unique(np.array(pairs, np.uint64)))
    for n, rows in sorted(found.items()):
        rows.sort()
        keys, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
        out.lengths.append(n)
        out.keys.append(keys)
        out.bounds.append(np.append(first, len(rows)))
        out.item.append(np.array([r[1] for r in rows]))
        out.place.append(np.array([r[2] for r in rows]))
    return out


def find_seeds(at: np.ndarray, rows: np.ndarray, seeds: Seeds) -> np.ndarray:
    """(position, item, place in the item) of every seed in the words ``at`` (-1: not of the vocabulary)."""
    none = np.zeros((0, 3), np.int64)
    if len(at) < 2 or not len(seeds.pairs):
        return none
    pos = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & (rows[:-1] == rows[1:]))
    key = _key(at, pos, 2)
    slot = np.minimum(np.searchsorted(seeds.pairs, key), len(seeds.pairs) - 1)
    pos = pos[seeds.pairs[slot] == key]
    out = [none]
    for n, keys, bounds, item, place in zip(seeds.lengths, seeds.keys, seeds.bounds, seeds.item, seeds.place, strict=True):
        p = pos[pos + n <= len(at)]
        p = p[rows[p] == rows[p + n - 1]]
        for k in range(2, n):
            p = p[at[p + k] >= 0]
        key = _key(at, p, n)
        slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[slot] == key
        p, slot = p[hit], slot[hit]
        many = bounds[slot + 1] - bounds[slot]
        at_ = np.repeat(bounds[slot] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        out.append(np.stack((np.repeat(p, many), item[at_], place[at_]), axis=1))
    return np.concatenate(out)


def align(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of ``item`` with each row of ``texts``: its sum and its first end, one past the last word."""
    n, width = texts.shape
    ramp = np.arange(1, width + 1, dtype=np.int32) * GAP
    h = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for word in item:
        t = np.maximum(h[:, :-1] + np.where(texts == word, MATCH, -MISS), h[:, 1:] - GAP)
        t = np.maximum(np.maximum(t, 0) + ramp, 0)
        h[:, 1:] = np.maximum.accumulate(t, axis=1) - ramp
        top = h[:, 1:].max(axis=1)
        better = top > best
        if better.any():
            best[better] = top[better]
            end[better] = h[better, 1:].argmax(axis=1) + 1
    return best, end


def match_words(at: np.ndarray, rows: np.ndarray, bounds: np.ndarray, items: Items, seeds: Seeds, threshold: float, passage: int = 13) -> list[tuple]:
    """(row, item, score, passage score, start, end) of the best passage for each row and item that counts."""
    hits = find_seeds(at, rows, seeds)
    if not len(hits):
        return []
    sizes = np.array([len(w) for w in items.words])
    diagonal = hits[:, 0] - hits[:, 2]
    # Diagonals closer than a quarter of the item share one window.
    step = np.maximum(4, sizes[hits[:, 1]] // 4)
    cells = np.unique(np.stack((hits[:, 1], rows[hits[:, 0]], (diagonal - bounds[rows[hits[:, 0]]]) // step), axis=1), axis=0)
    out: dict[tuple[int, int], tuple] = {}
    for i in np.unique(cells[:, 0]):
        item, mine = items.words[i], cells[cells[:, 0] == i]
        pad = max(4, len(item) // 4)
        for some in np.array_split(mine, max(1, len(mine) * (len(item) + 3 * pad) // 400_000)):
            row = some[:, 1]
            start = np.maximum(bounds[row] + some[:, 2] * pad - pad, bounds[row])
            index = start[:, None] + np.arange(len(item) + 3 * pad)[None, :]
            texts = np.where(index < bounds[row + 1][:, None], at[np.minimum(index, len(at) - 1)], -2)
            best, end = align(item, texts)
            whole = MATCH * len(item) * (threshold if len(item) >= SHORT else 1)
            for k in np.flatnonzero(best >= min(whole, MATCH * passage)):
                # The start is the end of the same alignment of both reversed.
                back = int(align(item[::-1], texts[k : k + 1, : end[k]][:, ::-1])[1][0])
                own = best[k] / (MATCH * back)
                if best[k] < whole and (own < threshold or len(item) < SHORT):
                    continue
                first = int(start[k] - bounds[row[k]])
                found = (int(row[k]), int(i), best[k] / (MATCH * len(item)), own, first + int(end[k]) - back, first + int(end[k]))
                old = out.get((int(row[k]), int(i)))
                if old is None or (found[2], -found[4]) > (old[2], -old[4]):
                    out[int(row[k]), int(i)] = found
    return [out[k] for k in sorted(out)]


def benchmark_blocks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20, min_words: int = 2, expected: float = 1.0):
    """(items, seeds) of each block of the benchmark; the words of all blocks are counted in one pass."""
    n = split_count(text_bytes(benchmark), block_bytes)
    block = lambda k: load_items(benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else benchmark, min_words)
    vocabulary, one = np.zeros(0, np.uint64), None
    for k in range(n):
        one = block(k)
        vocabulary = np.union1d(vocabulary, one.vocabulary)
    if not len(vocabulary):
        return
    counts, total = count_words(docs, vocabulary)
    for k in range(n):
        items = one if n == 1 else block(k)
        if len(items.ids):
            yield items, make_seeds(items, counts[lookup(vocabulary, items.vocabulary)], total, expected)


def _scan(part: pa.RecordBatch, items: Items, seeds: Seeds, threshold: float, passage: int) -> list[tuple]:
    h, rows, bounds = folded(part.column(part.schema.get_field_index("text")))
    return match_words(items.lookup(h), rows, bounds, items, seeds, threshold, passage)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, passage: int = 13, **options) -> DataFrame:
    """A row for each document and item with a passage that counts; words are counted from 0."""
    result = None
    for items, seeds in benchmark_blocks(docs, benchmark, **options):

        def each(batches, items=items, seeds=seeds):
            for batch in batches:
                for part in pieces(batch, "text"):
                    ids, found = part.column("doc_id").to_pylist(), _scan(part, items, seeds, threshold, passage)
                    cols = list(zip(*((ids[r], int(items.ids[i]), float(s), float(own), a, b) for r, i, s, own, a, b in found), strict=True)) or [[]] * 6
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], COLUMNS)

        one = docs.select("doc_id", "text").mapInArrow(each, SCHEMA)
        result = one if result is None else result.unionByName(one)
    return docs.sparkSession.createDataFrame([], SCHEMA) if result is None else result


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, passage: int = 13, **options) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark."""
    out = docs
    for items, seeds in benchmark_blocks(docs, benchmark, **options):

        def each(batches, items=items, seeds=seeds):
            for batch in batches:
                for part in pieces(batch, "text"):
                    keep = np.ones(len(part), dtype=bool)
                    keep[[x[0] for x in _scan(part, items, seeds, threshold, passage)]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(each, out.schema)
    return out

"""Substring dedup: repeated-phrase automata.

1. Documents are dealt into blocks that are ranges of doc_id.  A block sends, once for
   each distinct window of ``n`` words, its 64-bit hash to the window's bucket.
2. A bucket confirms recurring windows and answers each block with one bit per window:
   whether an earlier block holds it.  Blocks are ranges, so that means a document with
   a smaller id.  A window that every document holds costs one entry a block.
3. A block names its confirmed passages: windows that recur (in an earlier block, or in
   a smaller document of its own) and always follow each other, by the words of one
   occurrence and their first holder.  They are compiled into Aho-Corasick automata over
   word numbers, through which all documents of the block are streamed.  Occurrences come
   from the automata alone; one in a document behind the first holder is removed.

Blocks are the shards: a block's automata hold the passages that occur in it, so every
document meets every passage it has; each of at most ``shard`` words, whatever the corpus.
The texts are shuffled once, the answers are bits.  Blocks and buckets grow with the
corpus, within bounds, so that messages stay worth their heads.

Defined results: null and empty texts have no words; texts of fewer than ``n`` words lose
nothing; rows that share a doc_id don't remove from each other; a null doc_id counts as
smaller than any other; a very long text is a block's member like any other; of equal
passages the one in the smallest doc_id stays, in all rows that have that id; other
columns keep their values, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, bucket_bits, by_bucket, give_back, grown, in_ranges, pack, split_count, text_bytes, unpack, windows

NULL_ID = np.iinfo(np.int64).min
MESSAGE = "_bucket int, _block int, hashes binary"
ANSWER = "_block int, bucket int, bits binary, n int"


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy()


def _texts(table: pa.Table) -> pa.Array:
    found = table.column("text")
    return found.combine_chunks() if found.num_chunks != 1 else found.chunk(0)


def _announce(n: int, bits: int):
    def each(table: pa.Table) -> pa.Table:
        w = Words(_texts(table))
        hashes = np.unique(windows(w.hashes, w.rows, n)[0])
        block = table.column("_block")[0].as_py()
        found = list(by_bucket(hashes, bits))
        return pa.table(
            {"_bucket": pa.array([b for b, _ in found], pa.int32()), "_block": pa.array([block] * len(found), pa.int32()), "hashes": pa.array([pack(hashes[s]) for _, s in found], pa.binary())}
        )

    return each


def _answer(table: pa.Table) -> pa.Table:
    """For each message of a bucket, which of its hashes an earlier block sent too."""
    blocks = table.column("_block").to_numpy()
    parts = [unpack(x) for x in table.column("hashes").to_pylist()]
    sizes = np.array([len(p) for p in parts])
    h, b = np.concatenate(parts), np.repeat(blocks, sizes)
    order = np.lexsort((b, h))
    seen = np.zeros(len(h), dtype=bool)
    seen[order[1:]] = h[order[1:]] == h[order[:-1]]
    ends = np.cumsum(sizes)
    return pa.table(
        {
            "_block": pa.array(blocks, pa.int32()),
            "bucket": pa.array([table.column("_bucket")[0].as_py()] * len(blocks), pa.int32()),
            "bits": pa.array([np.packbits(seen[e - k : e]).tobytes() for e, k in zip(ends, sizes, strict=True)], pa.binary()),
            "n": pa.array(sizes, pa.int32()),
        }
    )


def _seen_before(answers: pa.Table) -> np.ndarray:
    """The bits of a block for its sorted distinct hashes."""
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("n").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    parts = [np.unpackbits(np.frombuffer(x, np.uint8), count=k).astype(bool) for _, k, x in rows]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def _as_text(numbers: np.ndarray) -> str:
    """Numbers as characters; those of the surrogates are left out."""
    shifted = numbers + np.where(numbers >= 0xD800 - 1, 0x800, 0) + 1
    return shifted.astype("<u4").tobytes().decode("utf-32-le")


#: Numbers a character can stand for.
LETTERS = 0x10FFFF - 0x800 - 1


@dataclass
class Passages:
    """Confirmed passages of a block: the words of one occurrence each, and who holds them first."""

    first: np.ndarray  # place of the first word of that occurrence
    last: np.ndarray  # one past its last word
    earlier: np.ndarray  # an earlier block holds the passage
    holder: np.ndarray  # else: the smallest id of the block that does


def passages(w: Words, ids: np.ndarray, before: np.ndarray, n: int) -> Passages:
    """The recurring passages of a block; ``before``: by sorted distinct window hash.

    Windows that always follow each other, with the same first holder, form one passage,
    so each occurrence of a window is part of an occurrence of its passage.
    """
    none = np.zeros(0, np.int64)
    hashes, at = windows(w.hashes, w.rows, n)
    if not len(hashes):
        return Passages(none, none, none.astype(bool), none)
    distinct, witness, of = np.unique(hashes, return_index=True, return_inverse=True)
    mine = ids[w.rows[at]]
    low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(low, of, mine)
    np.maximum.at(high, of, mine)
    recurs = before | (high > low)
    holder = np.where(before, NULL_ID, low)
    # The window one word on, and whether it follows at every occurrence.
    after = np.full(len(hashes), -1, dtype=np.int64)
    after[:-1] = np.where((np.diff(at) == 1) & (w.rows[at[1:]] == w.rows[at[:-1]]), of[1:], -1)
    many = np.bincount(of, minlength=len(distinct))
    then = after[witness]
    joint = np.bincount(of, after == then[of], len(distinct)).astype(np.int64)
    order = np.argsort(witness)
    order = order[recurs[order]]
    if not len(order):
        return Passages(none, none, none.astype(bool), none)
    x, y = order[:-1], order[1:]
    goes_on = (then[x] == y) & (witness[y] == witness[x] + 1) & (joint[x] == many[x]) & (many[y] == many[x]) & (before[x] == before[y]) & (holder[x] == holder[y])
    begin = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    end = np.append(begin[1:], len(order)) - 1
    return Passages(at[witness[order[begin]]], at[witness[order[end]]] + n, before[order[begin]], holder[order[begin]])


def removed_words(w: Words, ids: np.ndarray, before: np.ndarray, n: int, shard: int = 400_000) -> np.ndarray:
    """Which words of a block's documents are removed: those of the occurrences that the automata find.

    Each automaton holds passages of at most ``shard`` words (a longer one stands alone).
    """
    found = passages(w, ids, before, n)
    edge = np.zeros(len(w) + 1, dtype=np.int64)
    size = found.last - found.first
    for some in _shards(size, min(shard, LETTERS)):
        letters = np.unique(np.concatenate([w.hashes[a:b] for a, b in zip(found.first[some], found.last[some], strict=True)]))
        number = np.minimum(np.searchsorted(letters, w.hashes), len(letters) - 1)
        number = np.where(letters[number] == w.hashes, number + 1, 0)
        text = _as_text(number)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k in some.tolist():
            automaton.add_word(text[found.first[k] : found.last[k]], k)
        automaton.make_automaton()
        for row in range(w.n_rows):
            a, b = int(w.bounds[row]), int(w.bounds[row + 1])
            hits = np.array(list(automaton.iter(text[a:b])), dtype=np.int64).reshape(-1, 2) if b - a >= n else ()
            if not len(hits):
                continue
            end, k = a + hits[:, 0] + 1, hits[:, 1]
            taken = found.earlier[k] | (ids[row] > found.holder[k])
            np.add.at(edge, end[taken] - size[k[taken]], 1)
            np.add.at(edge, end[taken], -1)
    return np.cumsum(edge)[:-1] > 0


def _shards(size: np.ndarray, most: int):
    """Places of passages, dealt in order into groups of at most ``most`` words."""
    if not len(size):
        return []
    return np.split(np.arange(len(size)), np.flatnonzero(np.diff((np.cumsum(size) - 1) // most)) + 1)


def _blocks_and_answers(docs: DataFrame, n: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    size = text_bytes(docs)
    blocks = in_ranges(docs, split_count(size, grown(block_bytes, size)))
    sent = blocks.groupBy("_block").applyInArrow(_announce(n, bucket_bits(size // 6)), MESSAGE)
    return blocks, sent.groupBy("_bucket").applyInArrow(_answer, ANSWER)


def digests(docs: DataFrame, n: int = 13, block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    blocks, answers = _blocks_and_answers(docs.select("doc_id", "text"), n, block_bytes)

    def each(docs_: pa.Table, answers_: pa.Table) -> pa.Table:
        give_back()
        w = Words(_texts(docs_))
        gone = removed_words(w, _ids(docs_), _seen_before(answers_), n)
        raw, sha = w.raw.tobytes(), []
        for r in range(w.n_rows):
            keep = np.flatnonzero(~gone[w.bounds[r] : w.bounds[r + 1]]) + w.bounds[r]
            sha.append(hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)])).hexdigest())
        total = np.concatenate(([0], np.cumsum(gone)))
        return pa.table(
            {"doc_id": docs_.column("doc_id").cast(pa.int64()), "n_words": np.diff(w.bounds), "n_removed": total[w.bounds[1:]] - total[w.bounds[:-1]], "kept_sha256": pa.array(sha, pa.string())}
        )

    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(each, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, n: int = 13, block_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` (the rest keeps its white space) and n_chars to match."""
    # Columns go by number meanwhile: none can clash with the block's.
    names = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "text", "n_chars") else f"c{k}" for k, c in enumerate(names)])
    schema = docs.schema
    blocks, answers = _blocks_and_answers(docs, n, block_bytes)

    def each(docs_: pa.Table, answers_: pa.Table) -> pa.Table:
        give_back()
        texts = _texts(docs_)
        w = Words(texts)
        gone = removed_words(w, _ids(docs_), _seen_before(answers_), n)
        out, sizes = texts.to_pylist(), docs_.column("n_chars").to_pylist() if "n_chars" in docs_.column_names else None
        raw = w.raw.tobytes()
        for r in np.unique(w.rows[gone]):
            a, b = int(w.bounds[r]), int(w.bounds[r + 1])
            edge = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
            at, parts = int(w.offsets[r]), []
            for s, e in edge.reshape(-1, 2):
                parts.append(raw[at : w.starts[a + s]])
                at = int(w.starts[a + e]) if a + e < b else int(w.ends[b - 1])
            out[r] = b"".join([*parts, raw[at : w.offsets[r + 1]]]).decode()
            if sizes is not None:
                sizes[r] = len(out[r])
        made = docs_.drop_columns(["_block"])
        for name, values in (("text", out), ("n_chars", sizes)):
            if values is not None and name in made.column_names:
                k = made.column_names.index(name)
                made = made.set_column(k, made.schema.field(k), pa.array(values, made.schema.field(k).type))
        return made

    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(each, schema).toDF(*names)

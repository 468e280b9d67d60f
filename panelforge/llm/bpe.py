"""BPE encoding and decoding with content-defined chunk reuse.

1. A rolling hash of 16 bytes cuts a text wherever it says so, inside words too, about
   every ``every`` bytes (never inside a UTF-8 character): equal passages are cut alike in
   every document.
2. Each distinct chunk is encoded and decoded once per task (a bounded memo).
3. Joins are repaired: the bytes between the last sure boundary of a chunk and the first
   of the next are encoded together and take the place of both ends.  A boundary is sure
   where white space follows something else: this tokenizer parts a text there whatever
   stands around, so what lies between sure boundaries has the tokens of the whole text.
   A chunk without one is merged with its neighbours, again and again, until the piece
   lies between sure boundaries and all agree.  Joins are kept like chunks.

The tokenizer's own library encodes what is rare; plain Latin text goes through the same
vocabulary in a faster library (PLAIN).  Tokenizer files of another kind than byte-level
ones with PATTERN are not cut: their texts are encoded whole.

Texts pass once through Arrow batches; nothing is shuffled or collected.

Defined results: null text is an empty one, with no tokens; repeated rows are encoded
each; a very long text is cut like any other; special-token strings in a text become
special tokens, as in the library; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, mix, pieces, text_buffers

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
# How the byte-level pre-tokenizer splits a text, and texts of the characters
# that every Unicode version classes alike (ASCII, Latin letters).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\t-\r -~\u00a1-\u00ac\u00ae-\u024f]*")
SPACES = frozenset(bytes([b]) for b in b" \t\n\x0b\x0c\r")
_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


#: Sure boundaries: white space of one byte behind what is no white space (the others are U+85, U+A0, U+1680,
#: U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F and U+3000).
SURE = re.compile(rb"(?<=[^\t-\r ])(?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80)[\t-\r ]")
_GEAR = np.random.Generator(np.random.PCG64(16)).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def cuts(raw: np.ndarray, offsets: np.ndarray, every: int = 256) -> list[np.ndarray]:
    """Byte positions, from the text's own start, before which each text is cut."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):  # the hash of 16 bytes from those of 8, of 4, of 2, of 1
        h[k:] += h[:-k] * U64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
    at = np.flatnonzero((mix(h) % U64(every) == 0)[:-1]) + 1
    at = at[(raw[at] & 0xC0) != 0x80]
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at - offsets[row] >= 16  # all 16 bytes are of this text
    at, row = at[inside], row[inside]
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    return [at[bounds[i] : bounds[i + 1]] - offsets[i] for i in range(len(offsets) - 1)]


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level tokenizer file as ranks of byte strings, or None where ids don't follow the merges."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    pre, model = data.get("pre_tokenizer") or {}, data["model"]
    if data.get("normalizer") or data.get("post_processor") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE":
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    special = {t["content"] for t in data.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    follows = all(model["vocab"].get(x + y) == 256 + k for k, (x, y) in enumerate(merges))
    return ranks if follows and len(ranks) == 256 + len(merges) else None


def fast_coder(path: str):
    """The same vocabulary in the faster library, for texts both read alike (see PLAIN)."""
    key = f"fast:{path}"
    if key not in _LOADED:
        import tiktoken

        ranks = byte_ranks(path)
        _LOADED[key] = ranks and tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


class Coder:
    """Encodes and decodes texts chunk by chunk; ``most`` bounds the memo in bytes."""

    def __init__(self, path: str, most: int = 40 << 20):
        self.t, self.fast, self.most = tokenizer(path), fast_coder(path), most
        self.special = [t.content for t in self.t.get_added_tokens_decoder().values()]
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}  # pieces between sure boundaries: ids, decoded
        self.split: dict[bytes, tuple[bytes, bytes, bytes] | None] = {}  # chunks: head, core, tail
        self.used = self.seen = self.encoded = self.joins = self.repaired = 0

    def one(self, data: bytes) -> bytes:
        """Token ids of a string, by the tokenizer itself."""
        ids = self.t.encode_batch_fast([data.decode()], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, new: list[bytes]) -> None:
        """Encode and decode pieces that are not known yet."""
        slow = []
        for c in new:
            text = c.decode()
            if self.fast is None or PLAIN.fullmatch(text) is None or any(x in text for x in self.special):
                slow.append((c, text))
                continue
            ids = self.fast.encode_ordinary(text)
            out = self.fast.decode_bytes(ids)
            self.memo[c] = (struct.pack(f"<{len(ids)}I", *ids), c if out == c else out)
            self.used += len(c) + 4 * len(ids) + 300
        if slow:
            ids = [e.ids for e in self.t.encode_batch_fast([x for _, x in slow], add_special_tokens=False)]
            for (c, _), i, text in zip(slow, ids, self.t.decode_batch(ids, skip_special_tokens=False), strict=True):
                out = text.encode()
                self.memo[c] = (struct.pack(f"<{len(i)}I", *i), c if out == c else out)
                self.used += len(c) + 4 * len(i) + 300
        self.encoded += len(new)

    def parts(self, chunk: bytes) -> tuple[bytes, bytes, bytes] | None:
        """A chunk's bytes up to its first sure boundary, between first and last, and from the last; None without any."""
        found = [m.start() for m in SURE.finditer(chunk)]
        return (chunk[: found[0]], chunk[found[0] : found[-1]], chunk[found[-1] :]) if found else None

    def pieces(self, chunks: list[bytes]) -> list[bytes]:
        """A text as pieces between sure boundaries: cores of chunks, and what stands around each join."""
        out: list[bytes] = []
        open_ = b""
        for c in chunks:
            self.seen += 1
            if c in self.split:
                p = self.split[c]
            else:
                p = self.split[c] = self.parts(c)
                self.used += 2 * len(c) + 400
            if open_ and c[:1] in SPACES and SURE.match(open_[-3:] + c[:1], len(open_[-3:])):
                # The join itself is sure: nothing to repair.
                out.append(open_)
                open_ = b""
            if p is None:
                self.repaired += bool(open_)
                open_ += c
                continue
            head, core, tail = p
            if open_ or head:
                self.repaired += bool(open_ and head)
                out.append(open_ + head)
            if core:
                out.append(core)
            open_ = tail
        self.joins += max(0, len(chunks) - 1)
        return [*out, open_] if open_ else out

    def code(self, texts: list[list[bytes]]) -> list[tuple[bytes, bytes]]:
        """Token ids (little-endian 32 bit) and decoded bytes of texts given as chunks."""
        if self.used > self.most:
            self.memo.clear()
            self.split.clear()
            self.used = 0
        made = [self.pieces(t) if self.fast is not None else [b"".join(t)] if t else [] for t in texts]
        self.learn(list(dict.fromkeys([p for m in made for p in m if p not in self.memo])))
        found = [[self.memo[p] for p in m] for m in made]
        return [(b"".join([x[0] for x in f]), b"".join([x[1] for x in f])) for f in found]


def split_texts(column: pa.Array, every: int = 256) -> list[list[bytes]]:
    raw, offsets = text_buffers(column)
    data = raw.tobytes()
    out = []
    for i, at in enumerate(cuts(raw, offsets, every)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        edges = [a, *(a + at).tolist(), b]
        out.append([data[x:y] for x, y in zip(edges, edges[1:], strict=False) if y > x])
    return out


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32 bit), decoded (string) of each text."""
    path = path or default_path()

    def each(batches):
        coder = Coder(path)
        for batch in batches:
            for part in pieces(batch, "text"):
                got = coder.code(split_texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([x[0] for x in got], pa.binary()), pa.array([x[1].decode() for x in got], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The same as lengths and sha256 sums, taken where the texts are coded."""
    path = path or default_path()

    def each(batches):
        coder = Coder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part in pieces(batch, "text"):
                got = coder.code(split_texts(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(x[0]) // 4 for x in got], pa.int64()), pa.array([sha(x[0]) for x in got], pa.string()), pa.array([sha(x[1]) for x in got], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(each, SCHEMA)

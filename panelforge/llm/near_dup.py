"""MinHash near-dedup: one-permutation hashing with optimal densification, banded
buckets and star-shaped candidate edges, confirmed on full shingle sets.

1. One pass over the texts: the distinct 5-word shingles of each as 64-bit hashes, their
   number, a 128-bit identity of the set, and a signature of 128 bins; the minimum of a
   bin is one permutation's share, an empty bin copies a filled one found by probing.
2. Equal sets are one class; its smallest document represents it from here on.
3. 32 bands of 4 bins: a pair at similarity 0.75 misses all with probability 5e-6.
   In each bucket all members are linked with one centre, the member that meets most
   others over all its buckets: candidate edges grow with the members, not their pairs.
4. Edges are confirmed on full sets.  What a bucket still holds in several components is
   then compared in that bucket, across components, on full sets: pairs that share a rare
   shingle (a prefix filter, which loses none), in cells of bounded size that give back
   links alone, so no link between different texts is lost.  Nothing is closed over
   buckets, so chains of buckets make no giant group.

Sets are built for documents of shared buckets only.  Their ids go to the tasks if
their checked size allows, else texts are joined with them.

Defined results: null and empty texts have no shingles and are linked with nothing;
texts of one to four words are one shingle; repeated rows are copies of each other and
keep their rows; rows that share an id are one document with several texts, linked by
any of them, and each row shows its own n_shingles; a row without a doc_id has no
component and is kept; a very long text is one set; a pair at exactly the similarity is
linked; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, few_files, materialise, mix, pack, pieces, unpack, windows
from .components import components

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
EMPTY = np.uint16(0)


def shingle_sets(column, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Bounds by row and the sorted distinct shingle hashes of each text."""
    w = Words(column, lower=True)
    h, at = windows(w.hashes, w.rows, n)
    parts_h, parts_r = [h], [w.rows[at]]
    size = np.diff(w.bounds)
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            x, p = windows(w.hashes, w.rows, k, seed=k)
            mine = np.isin(w.rows[p], short)
            parts_h.append(x[mine])
            parts_r.append(w.rows[p][mine])
    h, r = np.concatenate(parts_h), np.concatenate(parts_r)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return np.searchsorted(r, np.arange(w.n_rows + 1)), h


def signatures(bounds: np.ndarray, h: np.ndarray) -> np.ndarray:
    """128 bins of 16 bits for each set; rows without shingles stay 0."""
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    bins = (h >> U64(57)).astype(np.int64)
    cell = rows * BINS + bins
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # hashes are sorted: the first of a bin is its minimum
    sig = np.zeros((n, BINS), dtype=np.uint16)
    sig.ravel()[cell[first]] = (mix(h[first]) >> U64(48)).astype(np.uint16) | np.uint16(1)
    filled = sig != EMPTY
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):  # optimal densification: bin and attempt alone say where to look
        attempt += 1
        at = (mix(col.astype(np.uint64) * U64(1_000_003) + U64(attempt)) >> U64(57)).astype(np.int64)
        ok = filled[row, at]
        sig[row[ok], col[ok]] = sig[row[ok], at[ok]]
        row, col = row[~ok], col[~ok]
    return sig


def _summaries(docs: DataFrame) -> DataFrame:
    def each(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                bounds, h = shingle_sets(part.column("text"))
                sig = signatures(bounds, h)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ U64(k))))) for k in (1, 2)]
                key = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds)), pa.array([x.tobytes() for x in key], pa.binary()), pa.array([x.tobytes() if f else None for x, f in zip(sig, np.diff(bounds) > 0, strict=True)], pa.binary())],
                    ["doc_id", "n_shingles", "key", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, n_shingles long, key binary, sig binary")


def _bands(reps: DataFrame) -> DataFrame:
    def each(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            sig = np.array([np.frombuffer(x, np.uint16) for x in batch.column("sig").to_pylist()], dtype=np.uint16).reshape(-1, BINS)
            if not len(ids):
                continue
            band = np.ascontiguousarray(sig).view(np.uint64).reshape(len(ids), BANDS)
            band = mix(band ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(band.ravel().view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["bucket", "doc_id"])

    return reps.select("doc_id", "sig").mapInArrow(each, "bucket long, doc_id long")


def _ids(ids: DataFrame, broadcast_ids: int) -> np.ndarray | None:
    """The sorted ids if they are at most ``broadcast_ids``, which is counted first."""
    return None if ids.count() > broadcast_ids else np.sort(ids.toPandas()["doc_id"].to_numpy(np.int64))


def _among(batch: pa.RecordBatch, known: np.ndarray, keep: bool) -> pa.RecordBatch:
    """Rows whose doc_id is (``keep``) or is not among the sorted ids; a null id is not."""
    at = batch.schema.get_field_index("doc_id")
    mine = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False)
    hit = np.zeros(len(mine), dtype=bool)
    if len(known):
        hit = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
    hit &= np.array(batch.column(at).is_valid())
    return batch.filter(pa.array(hit == keep))


def without_ids(docs: DataFrame, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """``docs`` but for the ids (distinct): few go to the tasks, more are joined."""
    known = _ids(ids, broadcast_ids)
    if known is None:
        return docs.join(ids, "doc_id", "left_anti").select(docs.columns)

    def each(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield _among(part, known, False)

    return docs.mapInArrow(each, docs.schema)


def _sets(docs: DataFrame, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """(doc_id, shingles) of the documents in ``ids`` (distinct)."""
    docs, known = docs.select("doc_id", "text"), _ids(ids, broadcast_ids)
    if known is None:
        docs = docs.join(ids, "doc_id", "left_semi")

    def each(batches):
        for batch in batches:
            batch = batch if known is None else _among(batch, known, True)
            for part in pieces(batch, "text"):
                bounds, h = shingle_sets(part.column("text"))
                sets = [h[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                key = [int(mix(x).sum(dtype=np.uint64).view(np.int64)) for x in sets]
                full = pa.array(np.diff(bounds) > 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(key, pa.int64()), pa.array([pack(x) for x in sets], pa.binary())], ["doc_id", "text", "shingles"]).filter(full)

    # Rows that share an id may have several texts: each is kept once.
    return materialise(docs.mapInArrow(each, "doc_id long, text long, shingles binary"), "shingle-sets").dropDuplicates(["doc_id", "text"])


def _confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (u, v) whose sets reach the similarity."""

    def each(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = np.zeros(len(a), dtype=bool)
            cached, values = None, None
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if x != cached:
                    cached, values = x, unpack(x)
                other = unpack(y)
                small, large = sorted((len(values), len(other)))
                if 100 * small < percent * large:
                    continue
                both = len(np.intersect1d(values, other, assume_unique=True))
                keep[i] = 100 * both >= percent * (small + large - both)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    left = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    right = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    return materialise(edges.select("u", "v").join(left, "v").join(right, "u").select("u", "v", "a", "b").mapInArrow(each, "u long, v long"), "links")


def _cell_links(sets: list[np.ndarray], comp: np.ndarray, may: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of sets (places) of different components that reach the similarity.

    Only sets that share one of their rarest shingles can: a set's prefix is its rarest
    ``n - ceil(percent * n) + 1``.  ``may``: the part of each set, where only pairs across parts count.
    """
    size = np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(len(sets)), size)
    _, number, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((number, many[number], doc))  # each set from its rarest shingle
    number, starts = number[order], np.concatenate(([0], np.cumsum(size)))
    place = np.arange(len(number)) - starts[doc]
    short = size - (size * percent + 99) // 100 + 1
    first = place < short[doc]
    # Postings of prefixes only; one that a single component holds links nothing.
    token, holder = number[first], doc[first]
    by = np.lexsort((holder, token))
    token, holder = token[by], holder[by]
    edge = np.flatnonzero(np.diff(token, prepend=-1))
    low, high = np.minimum.reduceat(comp[holder], edge), np.maximum.reduceat(comp[holder], edge)
    spans = {int(token[e]): (int(e), int(f)) for e, f, a, b in zip(edge, [*edge[1:], len(token)], low, high, strict=True) if a != b}
    out: list[tuple[int, int]] = []
    sorted_sets = [np.sort(number[starts[k] : starts[k + 1]]) for k in range(len(sets))]
    for k in range(len(sets)):
        near = [holder[spans[t][0] : spans[t][1]] for t in number[starts[k] : starts[k] + short[k]].tolist() if t in spans]
        if not near:
            continue
        near = np.unique(np.concatenate(near))
        near = near[(near > k) & (comp[near] != comp[k]) & (100 * np.minimum(size[near], size[k]) >= percent * np.maximum(size[near], size[k]))]
        if may is not None:
            near = near[may[near] != may[k]]
        for m in near.tolist():
            both = len(np.intersect1d(sorted_sets[k], sorted_sets[m], assume_unique=True))
            if 100 * both >= percent * (size[k] + size[m] - both):
                out.append((k, m))
    return out


def _across(rows: DataFrame, percent: int, cell: int = 1_000_000) -> DataFrame:
    """Links between different components that meet in a bucket, on full sets.

    ``rows``: bucket, doc_id, component, shingles.  A bucket of more than ``cell``
    shingles is dealt into parts by document, and each two parts meet in a task of their
    own; the pairs looked at in a cell are those that share a rare shingle.
    """
    sizes = rows.groupBy("bucket").agg(F.sum(F.octet_length("shingles") / 7).alias("n"))
    cut = rows.join(sizes, "bucket").withColumn("s", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(cell))).cast("int")).withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("s")).cast("int"))
    cells = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("j")).select(
        "bucket", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "doc_id", "component", "shingles", (F.col("i") <= F.col("j")).alias("first")
    )

    def each(table: pa.Table) -> pa.Table:
        ids, comp = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        one_part = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        may = None if one_part else np.array(table.column("first").to_numpy(zero_copy_only=False))
        links = _cell_links([unpack(x) for x in table.column("shingles").to_pylist()], comp, may, percent)
        pairs = np.sort(np.array([(ids[a], ids[b]) for a, b in links], np.int64).reshape(-1, 2), axis=1)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return cells.groupBy("bucket", "x", "y").applyInArrow(each, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, broadcast_ids: int = 4_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row with a text or without."""
    rows = materialise(_summaries(docs), "summaries")
    # Written first: a join with the plain table can be split where one class has very many rows.
    classes = materialise(few_files(rows.where("n_shingles > 0").groupBy("key", "n_shingles").agg(F.min("doc_id").alias("rep"))), "sets")
    known = materialise(rows.where("n_shingles > 0").select("doc_id", "key", "n_shingles").join(classes, ["key", "n_shingles"]).select("doc_id", "rep"), "classes")
    reps = known.where("doc_id = rep").select("doc_id").distinct()
    reps = materialise(few_files(rows.where("n_shingles > 0").join(reps, "doc_id", "left_semi").select("doc_id", "sig").distinct()), "representatives")
    # Rows that share an id are one document with several texts: their classes are linked.
    spread = known.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("top")).where("u != top")
    twins = materialise(known.join(spread, "doc_id").where("rep != u").select("u", F.col("rep").alias("v")).distinct(), "twins")

    bands = _bands(reps)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(bands.join(shared, "bucket"), "members")
    meets = members.groupBy("doc_id").agg(F.sum("n").alias("meets"))
    centre = members.join(meets, "doc_id").groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("doc_id")).alias("low"))).alias("top")).select("bucket", (-F.col("top.low")).alias("u"))
    edges = members.join(centre, "bucket").where("u != doc_id").groupBy("u", F.col("doc_id").alias("v")).agg(F.count("*").alias("bands"))
    edges = materialise(few_files(edges), "candidates")
    sets = _sets(docs, members.select("doc_id").distinct(), broadcast_ids)

    links = _confirm(edges, sets, percent).unionByName(twins)
    found = components(links)

    def labelled(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
        lab = labels.select(F.col("node").alias(column), F.col("component").alias("_c"))
        return df.join(lab, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")

    # What stayed apart in a bucket is compared there: in the smallest bucket of several
    # components only, where two or more hold the same documents.
    mixed = labelled(members.select("bucket", "doc_id").distinct(), found, "doc_id", "component")
    several = mixed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"), F.sum(F.xxhash64("doc_id") % 1_000_000_007).alias("who")).where("a != b")
    several = several.groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("bucket")
    apart = materialise(mixed.join(several, "bucket"), "apart")
    if not apart.isEmpty():
        across = _across(apart.join(sets.drop("text"), "doc_id"), percent)
        across = labelled(labelled(across, found, "u", "cu"), found, "v", "cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
        across = materialise(across, "across")
        if not across.isEmpty():
            joined = components(across)
            found = materialise(labelled(found, joined, "component", "_top").select("node", F.col("_top").alias("component")).unionByName(joined.join(found.select("node"), "node", "left_anti")), "components")
    # A class is as small as its representative, which is its smallest document.
    named = labelled(known.withColumnRenamed("rep", "_rep"), found, "_rep", "component_id").select("doc_id", "component_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(named, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 75, broadcast_ids: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows that are not their component's smallest document."""
    gone = near_duplicates(docs, percent, broadcast_ids).where("not kept").select("doc_id").distinct()
    return without_ids(docs, materialise(few_files(gone), "duplicates"), broadcast_ids)

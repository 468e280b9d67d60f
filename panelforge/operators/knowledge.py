"""Vectors and graphs: cosine search, k-hop neighbourhoods, edge lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import shared_table


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_similar(vectors: DataFrame, query: list[float], k: int, threshold: float = -1.0, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows most like a query vector above a threshold."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(column), q).alias("similarity")).where(F.col("similarity") > threshold).orderBy(F.col("similarity").desc(), key).limit(k)


def similarity_matrix(sources: DataFrame, targets: DataFrame, key: str = "vec_id", column: str = "embedding", block_bytes: int = 32 << 20) -> DataFrame:
    """Cosine of a stated set of sources with every target, in blocks of sources whose size is checked.

    A block is broadcast and meets the targets where they are read: no target is moved.
    """
    s = sources.select(F.col(key).alias("source"), F.col(column).alias("_s")).withColumn("_ss", F.sqrt(dot(F.col("_s"), F.col("_s"))))
    t = targets.select(F.col(key).alias("target"), F.col(column).alias("_t"), F.lit(0).alias("_one")).withColumn("_tt", F.sqrt(dot(F.col("_t"), F.col("_t"))))
    size = s.agg(F.sum(F.size("_s") * 4 + 32)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    out = None
    for k in range(n):
        block = (s.where(F.pmod(F.xxhash64("source"), F.lit(n)) == k) if n > 1 else s).withColumn("_one", F.lit(0))
        part = t.join(F.broadcast(block), "_one").select("source", "target", F.try_divide(dot(F.col("_s"), F.col("_t")), F.col("_ss") * F.col("_tt")).alias("similarity"))
        out = part if out is None else out.unionByName(part)
    return out


def top_of_each(sources: DataFrame, targets: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(source, target, similarity, place) of the k most similar targets of each source; ties by target."""
    w = Window.partitionBy("source").orderBy(F.col("similarity").desc_nulls_last(), "target")
    # The window's limit is pushed below its shuffle: each task sends k rows a source.
    return similarity_matrix(sources, targets, key, column).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def distinct_nodes(nodes: DataFrame, key: str, content: list[str]) -> DataFrame:
    """One row for each content, that of the smallest key; its key stands for the others."""
    return nodes.groupBy(*content).agg(F.min(key).alias(key))


def distinct_edges(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges once each, the smaller end first."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def within_steps(edges: DataFrame, start: DataFrame, steps: int, blocked: DataFrame | None = None) -> DataFrame:
    """(node, step) reached from ``start`` (node) in at most ``steps``; blocked nodes are reached but not left."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edge = shared_table(start.select("node").distinct().withColumn("step", F.lit(0)), "frontier")
    found = [edge]
    for k in range(1, steps + 1):
        # Each frontier is a table, so a plan holds one step.
        seen = reduce(DataFrame.unionByName, found).select("node")
        out = edge if blocked is None else edge.join(blocked.select("node"), "node", "left_anti")
        new = out.join(both, out["node"] == both["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("step", F.lit(k))
        edge = shared_table(new, "frontier")
        if edge.isEmpty():
            break
        found.append(edge)
    return reduce(DataFrame.unionByName, found)


def labelled_steps(edges: DataFrame, nodes: DataFrame, start: DataFrame, steps: int, labels: list[str]) -> DataFrame:
    """(node, step, label) of the nodes within ``steps`` that have one of ``labels``; ``nodes``: node, label."""
    return within_steps(edges, start, steps).join(nodes, "node").where(F.col("label").isin(labels))


def query_by_content(vectors: DataFrame, queries: DataFrame, edges: DataFrame, k: int, steps: int, labels: list[int], key: str = "vec_id") -> DataFrame:
    """Semantic search, then the neighbourhood of what it found, by label, once each, the nearest k of each query.

    ``vectors``: key, embedding, label; ``edges``: a, b of keys.  A node's rank is that of
    the found row it was reached from: fewer steps first, then the more similar, then the key.
    """
    hits = shared_table(top_of_each(queries, vectors, k, key).select("source", F.col("target").alias("node"), "similarity", F.lit(0).alias("step")), "hits")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    found = hits
    for n in range(1, steps + 1):
        further = found.where(F.col("step") == n - 1).join(both, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), "similarity", F.lit(n).alias("step"))
        found = shared_table(found.unionByName(further).groupBy("source", "node").agg(F.min(F.struct("step", (-F.col("similarity")).alias("far"))).alias("x")).select("source", "node", (-F.col("x.far")).alias("similarity"), F.col("x.step").alias("step")), "hits")
    named = found.join(vectors.select(F.col(key).alias("node"), "label"), "node").where(F.col("label").isin(labels))
    w = Window.partitionBy("source").orderBy("step", F.col("similarity").desc(), "node")
    return named.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("source", "node", "label", "step", "place")


def similar_errors(vectors: DataFrame, queries: DataFrame, solved: DataFrame, k: int, threshold: float, key: str = "vec_id") -> DataFrame:
    """Former traces for a new case: the k most similar cases above ``threshold`` that have a solution.

    ``solved``: key and solution columns; each case counts once, with its own solutions.
    """
    near = top_of_each(queries, vectors.join(solved.select(key).distinct(), key, "left_semi"), k, key).where(F.col("similarity") >= threshold)
    return near.join(solved.withColumnRenamed(key, "target"), "target")


def trunks(text: Column, size: int) -> Column:
    """A text cut to pieces of ``size`` characters."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))

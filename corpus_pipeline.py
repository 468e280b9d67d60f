"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of documents; the last one returns token ids.  Its result is the
next one's input, written between them, so lineage is cut there and lost executors cost
one stage at most.

Defined results: null and empty texts are scored as empty ones, so the first stage drops
them; rows without a doc_id, and those that share one, are judged row by row, but near
duplicates of one id go together; a very long text is one row like any other; ties go as
each stage's operator states; columns beside those of documents, whatever their names,
pass through to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import bpe, decontam, fm, near_dup, substring_dedup
from panelforge.llm.common import crc_of_id, materialise, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorisation machine scores below 0.7."""
    labels = read(spark, sf_dir, "labels").where(crc_of_id() % 4 != 2)
    return fm.keep_good(docs, fm.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each component."""
    return near_dup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words and more that a smaller document holds."""
    return substring_dedup.remove_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]

#: No SQL has the trained scores of the first stage: each stage is tested against a brute-force version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs

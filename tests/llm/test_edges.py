"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelforge.llm import bpe, decontam, fm, html_extract, lm, near_dup, quality_rules, substring_dedup, toxicity, url_filter

LONG = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"
CLASH = ["_block", "_key", "key", "sig", "score", "n_words", "quality", "toxic", "label", "component_id", "host", "tokens", "_t", "u", "v", "_c", "bucket"]


def rows():
    base = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, LONG, "en", "a", len(LONG)), (5, "one", "de", "b", 3), (6, "One", "de", "b", 3)]
    copies = [(k, "the same few words in every copy of this text and a bit more to be long enough", "en", "a", 80) for k in range(10, 16)]
    return base + copies + [copies[0], (None, "no id has this row", "en", "a", 18), (20, "x" * 40_000, "en", "a", 40_000)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), DOC)
    for c in CLASH:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, None), (10, 1, 0), (10, 1, 0), (None, 1, 1), (99, 0, 1)], LABEL)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "few words in every copy of this text"), (3, "few words in every copy of this text"), (None, "x y z"), (4, "two words")], "item_id long, text string").withColumn("score", F.lit(1))


@pytest.fixture(scope="module")
def pages(spark):
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>a &amp; b<p>c</article></body></html>"
    data = [(1, None, None), (2, "http://h.org/x", ""), (3, "no scheme", "plain text"), (4, "https://H.org/y?q", page), (4, "https://H.org/y?q", page), (5, "http://h.org", "<p>unclosed <b>bold"), (6, "http://h.org/z", "<article>" + "word " * 50_000), (None, "http://h.org/z", "<")]
    return spark.createDataFrame(data, "page_id long, url string, html string").withColumn("host", F.lit("own")).withColumn("tokens", F.lit("own")).withColumn("good", F.lit("own"))


def n(df):
    return sorted(df.collect(), key=repr)


def test_rules(docs):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.quality_rules(docs, min_group=3).collect()}
    assert len(got) == len(rows()) - 1  # the repeated row is there twice
    assert got[1, 0]["base_failed"] and not got[1, 0]["kept"] and got[4, 60_000]["n_repeat_words"] == 0
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_repeats(docs):
    got = n(substring_dedup.digests(docs, block_bytes=2000))
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got}
    assert by[10]["n_removed"] == 0 and by[11]["n_removed"] == by[11]["n_words"] == 18 and by[4]["n_removed"] == 0 and by[1]["n_words"] == 0
    kept = substring_dedup.remove_repeats(docs, block_bytes=2000)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    k = {r["doc_id"]: r for r in kept.collect()}
    assert k[12]["text"] == "" and k[12]["n_chars"] == 0 and k[4]["text"] == LONG and k[1]["text"] is None and k[5]["_block"] == "own _block"
    assert substring_dedup.digests(docs.limit(0)).count() == 0


def test_pages(pages):
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["text"] == "plain text" and got[4]["text"] == "T\na & b\nc" and got[5]["text"] == "unclosed bold" and got[6]["n_chars"] == 249_999
    assert n(html_extract.extract(pages)) == n(html_extract.extract(pages, broadcast_bytes=-1))
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_toxicity(docs, labels):
    assert toxicity.toxicity(docs, labels).count() == len(rows())
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert all(r["severity"] < 1e-6 for r in none)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_tokens(docs):
    got = {r["doc_id"]: r for r in bpe.encode(docs).collect()}
    assert got[1]["decoded"] == "" and got[4]["decoded"] == LONG and got[3]["decoded"] == " \n\t "
    assert bpe.digests(docs.limit(0)).count() == 0


def test_urls(pages, spark):
    outcomes = spark.createDataFrame([("http://h.org/a", 1), ("http://h.org/b", None), (None, 0)], "url string, good int")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, outcomes).collect()}
    assert (got[1]["host"], got[1]["path"]) == ("", "") and (got[4]["host"], got[4]["path"]) == ("h.org", "/y") and got[2]["rule"] == "org/" and got[5]["rule"] is None
    assert url_filter.filter_urls(pages, outcomes.limit(0)).where("verdict is null").count() == 0
    assert url_filter.filter_urls(pages.limit(0), outcomes).count() == 0


def test_quality(docs, labels):
    got = n(fm.quality_scores(docs, labels))
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in fm.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    kept = fm.keep_good(docs, fm.fit(docs, labels), 0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows())
    assert fm.quality_scores(docs.limit(0), labels).count() == 0


def test_leaks(docs, bench):
    got = n(decontam.contamination(docs, bench).select("doc_id", "item_id"))
    assert [r["doc_id"] for r in got] == sorted([k for k in [*range(10, 16), 10] for _ in range(2)]) and {r["item_id"] for r in got} == {3}
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows()) - 7
    assert decontam.contamination(docs.limit(0), bench).count() == 0 and decontam.contamination(docs, bench.limit(0)).count() == 0


def test_near(docs):
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs).collect()}
    assert {got[k]["component_id"] for k in range(10, 16)} == {10} and got[6]["component_id"] == 5 and got[5]["n_shingles"] == 1
    assert got[1]["n_shingles"] == 0 and got[1]["kept"] and got[2]["component_id"] == 2 and got[3]["kept"] and got[None]["kept"]
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 10, 20, None}
    assert {r["doc_id"] for r in near_dup.one_of_each(docs, broadcast_ids=0).collect()} == {1, 2, 3, 4, 5, 10, 20, None}
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_scores(docs):
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, block_bytes=50_000).collect()}
    assert got[1]["n_tokens"] == 1 and got[4]["n_tokens"] == 60_001 and all(r["score"] < 0 for r in got.values())
    assert lm.lm_scores(docs.limit(0)).count() == 0


def test_near_dup_tables_of_aggregates_have_few_files(spark):
    """Links as without it, in fewer part files than there are partitions."""
    rows = [(k, " ".join(f"w{k // 2 if j < 28 else k}x{j}" for j in range(30))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    there = set(shared.iterdir())
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found == {k: k // 2 * 2 for k in range(400)}
    files = {p.name.rsplit("-", 1)[0]: len(list(p.glob("part-*"))) for p in set(shared.iterdir()) - there}
    most = 4 * spark.sparkContext.defaultParallelism
    assert all(0 < files[name] <= most for name in ("sets", "representatives", "candidates", "edges")), files

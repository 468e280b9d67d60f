"""Results against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import bpe, common, decontam, fm, html_extract, lm, near_dup, quality_rules, substring_dedup, toxicity
from panelforge.llm.common import read
from panelforge.llm.components import components
from panelforge.llm.queries import op6_host_reputation

DATA = "/root/testdata/sf0.001"
SPLIT = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPLIT.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, DATA, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_words_of_a_batch():
    data = ["a  bc\n", None, "", "é\x85x y", " \t", "zz"]
    w = common.Words(pa.array(data, pa.string()))
    raw = w.raw.tobytes()
    got = [[raw[w.starts[k] : w.ends[k]].decode() for k in range(w.bounds[i], w.bounds[i + 1])] for i in range(len(data))]
    assert got == [words(t) for t in data]
    big = common.Words(pa.array(["k" * 700_000 + " a b a"], pa.string()))
    assert len(set(big.hashes.tolist())) == 3 and big.hashes[1] == big.hashes[3]


def test_packing():
    h = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (common.unpack(common.pack(h)) == h).all() and (common.unpack_small(common.pack_small(h[::-1])) == h[::-1]).all()
    found = list(common.by_bucket(h, 4))
    assert sum(s.stop - s.start for _, s in found) == 1000 and all(((h[s] >> np.uint64(60)) == b).all() for b, s in found)


@pytest.mark.parametrize(("blocks", "coarse"), [(1, 8), (7, 8), (40, 4), (30, 2)])
def test_blocks_are_ranges(spark, blocks, coarse):
    rng = random.Random(2)
    ids = [rng.randrange(10**6) ** 2 for _ in range(900)] + [5] * 40 + [None]
    df = common.in_ranges(spark.createDataFrame([(i,) for i in ids], "doc_id long"), blocks, coarse=coarse)
    got = sorted((r["b"], r["lo"], r["hi"]) for r in df.where("doc_id is not null").groupBy(F.col("_block").alias("b")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect())
    assert all(x[2] < y[1] for x, y in zip(got, got[1:])) and df.count() == len(ids)
    assert len(got) >= min(blocks, 3) and df.where("doc_id is null").first()["_block"] == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(500, 540)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_rule_statistics(docs, texts):
    for r in quality_rules.base_statistics(docs).collect():
        t = texts[r["doc_id"]] or ""
        w = words(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_determinant_steps(spark):
    """The robust estimate against the same steps in numpy, and outliers that a plain mean would hide."""
    rng = np.random.default_rng(4)
    rows = [(k, "en", "s", *(int(x) for x in (rng.integers(200, 400), 0, 0, 0, 0))) for k in range(400)]
    rows = [(k, lang, s, n, n * 5 + int(rng.integers(0, 40)), int(rng.integers(0, 3)), 0, 0) for k, lang, s, n, *_ in rows]
    rows += [(1000 + k, "en", "s", 300, 1500, 900, 0, 0) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long").withColumn("usable", F.lit(True))
    got = {r["doc_id"]: r for r in quality_rules.robust_outliers(df).collect()}
    assert all(got[k]["outlier"] for k in range(1000, 1060)) and not any(got[k]["outlier"] for k in range(400))
    v = np.array([[math.log(r[3]), math.log(r[4] / r[3]), math.sqrt(r[5] / r[4]), 0, 0] for r in rows])
    floor = np.array(list(quality_rules.VECTOR.values()))
    q = np.quantile(v, [0.25, 0.5, 0.75], axis=0)
    m, c = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2 + floor**2)
    dist = lambda: np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(c), v - m)
    for _ in range(3):
        d = dist()
        near = v[d <= np.quantile(d, 0.75)]
        m, c = near.mean(0), np.cov(near.T, bias=True) + np.diag(floor**2)
    d = dist()
    d /= max(np.median(d) / quality_rules.CHI2_MEDIAN, 1)
    np.testing.assert_allclose([got[r[0]]["distance"] for r in rows], d, rtol=0.05, atol=0.05)


@pytest.mark.parametrize("share", [0.2, 0.25, 0.34, 0.45])
def test_copies_of_junk_are_outliers(spark, share):
    """Copies that pass a quarter of a group do not become its core."""
    rng = np.random.default_rng(7)
    rows = [(k, "en", "s", int(rng.integers(100, 600)), 0, int(rng.integers(0, 4)), 0, 0) for k in range(300)]
    rows = [(k, lang, s, n, n * 5 + int(rng.integers(0, 60)), *rest) for k, lang, s, n, _, *rest in rows]
    rows += [(1000 + k, "en", "s", 300, 1500, 450, 0, 0) for k in range(round(300 * share / (1 - share)))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long").withColumn("usable", F.lit(True))
    got = {r["doc_id"]: r["outlier"] for r in quality_rules.robust_outliers(df).collect()}
    assert all(out == (k >= 1000) for k, out in got.items())


@pytest.mark.parametrize(("n", "every"), [(5, 99), (7, 99), (15, 3), (30, 3)])
def test_frequent_words_have_seeds_in_large_corpora(n, every):
    """Copies, whole or with every third word replaced, of items of words with 3% of 5e9 words each."""
    item = np.arange(n) % 30
    items = decontam.Items(np.array([1]), np.arange(30, dtype=np.uint64), [item])
    seeds = decontam.make_seeds(items, np.full(30, 150_000_000), 5_000_000_000, 1.0)
    for first in range(3):
        text = np.where(np.arange(n) % every == (first if every == 3 else n), -1, item)
        at = np.concatenate((np.full(4, -1), text, np.full(4, -1)))
        found = decontam.match_words(at, np.zeros(len(at), np.int64), np.array([0, len(at)]), items, seeds, 0.45)
        assert [x[:2] for x in found] == [(0, 0)]


@pytest.mark.parametrize("block", [10_000, 1 << 22])
def test_repeated_passages(docs, texts, block):
    first, n = {}, 13
    for i in sorted(texts):
        w = words(texts[i])
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    for r in substring_dedup.digests(docs, n, block).collect():
        w = words(texts[r["doc_id"]])
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < r["doc_id"] for j in range(n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_automata_alone_locate(texts, monkeypatch):
    """Passages are named by one occurrence; without the automata nothing is found, in small shards all is."""
    data = {i: (t or "")[:4000] for i, t in sorted(texts.items())[:60]}
    first, n = {}, 13
    for i, t in data.items():
        for k in range(len(words(t)) - n + 1):
            first.setdefault(tuple(words(t)[k : k + n]), i)
    w, ids = common.Words(pa.array(list(data.values()))), np.array(list(data))
    want = np.concatenate([np.isin(np.arange(len(x)), [k + j for k in range(len(x) - n + 1) if first[tuple(x[k : k + n])] < i for j in range(n)]) for i, x in ((i, words(t)) for i, t in data.items())])
    before = np.zeros(len(np.unique(common.windows(w.hashes, w.rows, n)[0])), dtype=bool)
    assert want.any() and (substring_dedup.removed_words(w, ids, before, n) == want).all()
    assert (substring_dedup.removed_words(w, ids, before, n, shard=40) == want).all()
    found = substring_dedup.passages(w, ids, before, n)
    spans = [w.hashes[a:b].tobytes() for a, b in zip(found.first, found.last)]
    assert len(set(spans)) == len(spans)

    class Blind:
        def __init__(self, *_):
            self.add_word, self.make_automaton, self.iter = (lambda *_: None), (lambda: None), (lambda _: iter(()))

    monkeypatch.setattr(substring_dedup.ahocorasick, "Automaton", Blind)
    assert not substring_dedup.removed_words(w, ids, before, n).any()


def test_passages_in_loops():
    """Words that repeat in themselves, against brute force."""
    rng = random.Random(4)
    for _ in range(60):
        data = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) for _ in range(6)]
        n, first, want = 3, {}, []
        for i, t in enumerate(data):
            x = t.split()
            for k in range(len(x) - n + 1):
                first.setdefault(tuple(x[k : k + n]), i)
            gone = {k + j for k in range(len(x) - n + 1) if first[tuple(x[k : k + n])] < i for j in range(n)}
            want += [k in gone for k in range(len(x))]
        w = common.Words(pa.array(data))
        before = np.zeros(len(np.unique(common.windows(w.hashes, w.rows, n)[0])), dtype=bool)
        assert substring_dedup.removed_words(w, np.arange(6), before, n).tolist() == want


def test_cut_texts_keep_the_other_words(docs, texts):
    digest = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.digests(docs).collect()}
    for r in substring_dedup.remove_repeats(docs).collect():
        assert hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() == digest[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) or r["text"] == texts[r["doc_id"]]


def test_pages_hold_their_documents(spark, texts):
    """Each page of the tables shows a document; its lines are the blocks below the heading."""
    pages = read(spark, "/root/testdata/sf0.01", "pages")
    known = {r["doc_id"]: r["text"] for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    for r in html_extract.extract(pages).collect():
        shown = known[int(re.search(r"/(\d+)(?:/|\.html)?(?:[?#].*)?$", r["url"])[1])]
        assert r["text"].split("\n", 1)[1:] == ["\n".join(x for x in (" ".join(line.split()) for line in shown.split("\n")) if x)]


HOSTILE = """<!doctype html><html><head><title>t</title></head><body class="with-sidebar"><header><a href=x>Home</a></header>
<div class="cookie-notice">We use cookies</div><div id="ad-1">Buy</div><aside>side</aside><main><h1>Head &lt;1&gt;</h1>
<p>First   <i>par</i>agraph<script>var a = "<p>no</p>"</script> ends.</p><form><input name=q>search</form><ul><li>one<li>two</ul>
<div class="comments"><p>first!</p></div></main><footer>foot</footer></body></html>"""


def test_hostile_page():
    assert html_extract.blocks(HOSTILE) == ["Head <1>", "First paragraph ends.", "one", "two"]


def test_names_that_only_look_like_marks():
    page = "<body><main><section id='search-algorithms'>A</section><p class='notice-of-award'>B</p><div id='share-prices'>C</div><div class='ad-box'>D</div><div class='social share'>E</div><article class='comment'>F</article><article class='comment-list'>G</article></main></body>"
    assert html_extract.blocks(page) == ["A", "B", "C"]


def test_templates_find_boilerplate_without_an_article(spark):
    page = lambda k: f"<html><body><div>Site name</div><div><p>Story {k} tells of things {k * 7}.</p></div><div>All rights reserved</div></body></html>"
    pages = spark.createDataFrame([(k, f"http://x.org/{k}", page(k)) for k in range(8)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract(pages).collect()} == {f"Story {k} tells of things {k * 7}." for k in range(8)}


def _design(k, story, kind):
    menu = "<ul class=m>" + "".join(f"<li>{w}" for w in ("home", "news", f"more{k % 5}")) + "</ul>"
    foot = f"<p class=f>(c) all rights {k % 7} reserved by us</p>"
    slot = {"article": ("<article>", "</article>"), "story": ("<div class=story>", "</div>"), "row": ("<table class=row><tr><td>", "</td></tr></table>")}[kind]
    return f"<html><body>{menu}<div class=top>Buy now {k % 3}</div>{slot[0]}<p>{'</p><p>'.join(story)}</p><p class=tail>Read on in our paper</p>{slot[1]}{foot}</body></html>"


def test_templates_decide(spark):
    """Designs with and without an article element, several on one host; text that a class holds on all its pages falls out."""
    rng, made = random.Random(6), []
    say = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randrange(3, 30)))
    for k in range(90):
        host, kind = ("one.org", "article") if k < 30 else ("two.org", ("story", "row")[k % 2])
        story = [say() for _ in range(rng.randrange(1, 9))]
        made.append((k, f"http://{host}/{k}", _design(k, story, kind), "\n".join(story)))
    pages = spark.createDataFrame([x[:3] for x in made], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == {x[0]: x[3] for x in made}
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages, broadcast_bytes=-1).collect()} == got
    # Without templates the menu, the adverts and the footer would be text.
    assert all("Buy now" in "\n".join(html_extract.blocks(x[2])) for x in made[30:])


def test_copies_make_no_template(spark):
    """Three copies, and three near copies, of one article are no template; a host's whole article stays."""
    story = [f"Line {i} of a story that all pages tell in full." for i in range(6)]
    same = [(k, f"http://a.org/{k}", _design(k, story, "article")) for k in range(3)]
    near = [(9 + k, f"http://b.org/{k}", _design(k, [f"Odd {k}", *story], "article")) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(same + near, "page_id long, url string, html string")).collect()}
    assert all("\n".join(story) in t for t in got.values())


def test_templates_against_plain_vectors(spark):
    """The classes of each host from vectors held in full."""
    pages = read(spark, DATA, "pages")
    rows = [(r["url"], r["page_id"], r["html"]) for r in pages.collect()]
    vector, content, mass = {}, {}, {}
    for url, i, source in rows:
        host = re.match(r"[^:]*://([^/?#]*)", url)[1].lower()
        found, content[i] = html_extract.page_tokens(html_extract.read_page(source))
        for t, (k, m) in found.items():
            vector.setdefault((host, t), {})[i] = k
            mass[host, t] = mass.get((host, t), 0) + m
    vector = {x: v for x, v in vector.items() if len(v) >= 3 and len({content[i] % 64 for i in v}) >= 3}
    classes = {}
    for (host, t), v in vector.items():
        classes.setdefault((host, tuple(sorted(v.items()))), []).append(t)
    want = set()
    for (host, v), tokens in classes.items():
        once = all(k == 1 for _, k in v)
        valid = len(tokens) > 1 and once and any(mass[host, t] >= 0 for t in tokens)
        want |= {(host, t, 1 if valid else 0) if mass[host, t] >= 0 else (host, t, 2) for t in tokens if mass[host, t] >= 0 or valid}
    hosted = html_extract.with_host(pages)
    got = {(r["host"], r["token"] % 2**64, r["kind"]) for r in html_extract.templates(hosted).collect()}
    assert got == want and any(k == 1 for _, _, k in want)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = toxicity.score(docs, toxicity.fit(docs, labels.where(~held))).join(labels.where(held), "doc_id").select("severity", "toxic_probability", labels["toxic"].alias("y")).toPandas()
    hit = (got["toxic_probability"] >= 0.2) == (got["y"] == 1)
    assert hit.mean() > 0.97 and got[got.y == 1]["severity"].mean() > 1 > 0.1 > got[got.y == 0]["severity"].mean()


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(2)
    strong = rng.random((600, 3)) < 0.3
    grade = strong.sum(axis=1)
    keys, bounds = np.concatenate([np.flatnonzero(r) for r in strong]).astype(np.int32), np.concatenate(([0], np.cumsum(strong.sum(axis=1))))
    m = toxicity.train(grade, bounds, keys, z=1.0)
    expected = m.above(m.eta(bounds, keys)).sum(axis=1)
    assert (np.diff(m.thetas) >= 0).all() and np.corrcoef(expected, grade)[0, 1] > 0.97


def test_bpe_round_trip(texts):
    t = bpe.tokenizer(bpe.default_path())
    odd = ["", None, "a  b   c", "<|endoftext|> x <|endoftext|>", "x" * 3000, "it's  a\n\n\nb \t c ", "é 漢字 🎉 " * 20, "  a  b　", "  ", " a" * 300, "naïve ŠŽ ²³ ½", "a\x0b b\x1c c\x85 d\u2028 e", "\n\n a<|endoftext|>\n\n", "we'll they're 12 345 !?" * 9]
    data = [*texts.values(), *odd]
    want = t.encode_batch([x or "" for x in data], add_special_tokens=False)
    for every in (2, 16, 256):
        coder = bpe.Coder(bpe.default_path())
        chunks = bpe.split_texts(pa.array(data, pa.string()), every)
        got = coder.code(chunks)
        assert ["".join(x.decode() for x in c) for c in chunks] == [x or "" for x in data]
        assert [x[0] for x in got] == [np.array(e.ids, "<u4").tobytes() for e in want]
        assert [x[1].decode() for x in got] == [t.decode(e.ids, skip_special_tokens=False) for e in want]
        assert coder.repaired > 0 and coder.encoded < coder.seen + coder.joins


def test_bpe_random_joins():
    """Any cut of any text, against the tokenizer."""
    rng, t = random.Random(9), bpe.tokenizer(bpe.default_path())
    coder = bpe.Coder(bpe.default_path())
    alphabet = list("abz'sltd    \n\t\r019.,!?-é²漢🎉\u00a0\u2003\u2003\u3000\x1c\x85") + ["<|endoftext|>", "ing", " the", "'ll"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        edges = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(rng.randrange(0, 9)))})
        [(ids, decoded)] = coder.code([[text[a:b].encode() for a, b in zip(edges, edges[1:])]])
        want = t.encode(text, add_special_tokens=False).ids
        assert ids == np.array(want, "<u4").tobytes() and decoded.decode() == t.decode(want, skip_special_tokens=False)


def test_bpe_joins_need_repair(texts):
    """Chunks encoded alone and strung together are wrong; equal passages give equal chunks."""
    coder = bpe.Coder(bpe.default_path())
    data = [t for t in texts.values() if t and len(t) > 2000][:20]
    chunks = bpe.split_texts(pa.array(data))
    assert any(b"".join(coder.one(x) for x in c) != coder.one(t.encode()) for c, t in zip(chunks, data))
    passage = data[0][:2000]
    a, b = bpe.split_texts(pa.array(["one way in " + passage, "another and longer " + passage]))
    assert len(set(a) & set(b)) >= len(a) - 3


def test_bpe_memo_is_bounded(texts):
    coder = bpe.Coder(bpe.default_path(), most=20_000)
    for t in list(texts.values())[:40]:
        [(ids, _)] = coder.code(bpe.split_texts(pa.array([t])))
        assert ids == coder.one((t or "").encode())
    assert coder.used < 200_000


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = read(spark, d, "labels")
    got = fm.quality_scores(read(spark, d, "documents"), labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97 and len(got) > 50


def test_machine_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    m = fm.Machine(3, np.zeros(2), np.ones(2), 0.3, rng.normal(size=10), rng.normal(size=(10, 4)))
    bounds, keys, d = np.array([0, 3]), np.array([1, 4, 6], np.int32), np.array([[0.5, -1.0]])
    x = np.zeros(10)
    x[keys], x[8:] = 1 / np.sqrt(3), d[0]
    want = 0.3 + m.w @ x + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(10) for j in range(i))
    assert m.logit(bounds, keys, d)[0] == pytest.approx(want)


def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(7)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, (3, 20))
        assert decontam.align(a, b)[0].tolist() == [slow_align(a, x) for x in b]


def test_edited_leaks(spark):
    rng = random.Random(5)
    vocab = [f"word{k}" for k in range(4000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(40) for _ in range(20)]
    docs, want = [], set()
    for k in range(200):
        w = text(300)
        if k % 4 == 0:
            item = list(items[k % 20])
            for p in rng.sample(range(40), 6):  # substitutions
                item[p] = rng.choice(vocab)
            del item[rng.randrange(len(item))]
            item.insert(rng.randrange(len(item)), "inserted")
            w[100:100] = [x.upper() + "," for x in item]
            want.add((k, k % 20))
        docs.append((k, " ".join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = decontam.contamination(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(95 <= r["start_word"] <= 106 and 130 <= r["end_word"] <= 142 for r in got)
    blocks = decontam.contamination(d, b, block_bytes=1000).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == want


def test_seeds_against_all_alignments(spark):
    """Every document aligned with every item, without seeds: all that counts is found, nothing else."""
    rng = random.Random(11)
    vocab = [f"v{k}" for k in range(300)] + ["the", "of", "and"] * 60
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(n) for n in (2, 3, 4, 5, 8, 20, 40, 60, 60)]
    docs = []
    for k in range(150):
        w, item = text(rng.randrange(0, 120)), rng.choice(items)
        a = rng.randrange(len(item))
        part = item[a : a + rng.randrange(2, 61)] if k % 3 else list(item)
        part = [x if rng.random() > 0.1 * (k % 4) else rng.choice(vocab) for x in part]
        docs.append((k, " ".join(w + part + text(rng.randrange(0, 30)))))
    number = {w: i for i, w in enumerate(dict.fromkeys(vocab))}
    want, near = set(), set()
    for k, t in docs:
        d = np.array([[number[x] for x in t.split()]])
        for i, item in enumerate(items):
            best, end = decontam.align(np.array([number[x] for x in item]), d)
            whole = 2 * len(item) * (0.5 if len(item) >= 5 else 1)
            if best[0] >= whole:
                want.add((k, i))
            elif best[0] >= 26 and len(item) >= 5:
                back = decontam.align(np.array([number[x] for x in item[::-1]]), d[:, : end[0]][:, ::-1])[1][0]
                (want if best[0] / (2 * back) >= 0.5 else near).add((k, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()}
    assert len(want) > 60 and got <= want | near and len(got & want) >= 0.9 * len(want)
    long = {(k, i) for k, i in want if len(items[i]) >= 20}
    assert len(got & long) >= 0.97 * len(long)


def brute_near(texts):
    sets = {}
    for i, t in texts.items():
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(docs, texts, spark):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs).collect()} == brute_near(texts)
    # A chain: neighbours are linked, ends are not, and many are close but below the mark.
    rng = random.Random(3)
    base = [f"t{k}" for k in range(120)]
    made = {}
    for k in range(60):
        w = list(base)
        for p in rng.sample(range(120), 3 + k % 5):
            w[p] = f"new{k}x{p}"
        made[k] = " ".join(w)
    got = near_dup.near_duplicates(spark.createDataFrame(list(made.items()), "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_near(made)


def test_near_duplicates_of_shared_ids(spark):
    """Rows that share an id are one document with several texts, linked by any of them."""
    t = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    rows = [(1, t["a"]), (5, t["a"]), (5, t["b"]), (7, t["b"]), (9, t["b"] + " word"), (11, t["c"]), (None, t["a"]), (12, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (9, 1, False), (11, 11, True), (12, 12, True)]


def test_cells_against_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (4, 60), dtype=np.uint64)
    sets = []
    for k in range(90):
        own = rng.integers(0, 2**63, rng.integers(0, 25), dtype=np.uint64)
        sets.append(np.unique(np.concatenate((rng.choice(base[k % 4], rng.integers(40, 61), replace=False), own))))
    comp, part = np.arange(90) // 2, rng.random(90) < 0.5
    sim = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if comp[a] != comp[b] and sim(sets[a], sets[b])}
    assert len(want) > 20 and set(near_dup._cell_links(sets, comp, None, 75)) == want
    assert set(near_dup._cell_links(sets, comp, part, 75)) == {(a, b) for a, b in want if part[a] != part[b]}


def test_signature_estimates():
    rng = np.random.default_rng(8)
    shared, own = np.unique(rng.integers(0, 2**63, 600, dtype=np.uint64)) * np.uint64(2), lambda k: rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2)
    hits = []
    for _ in range(40):
        a, b = (np.sort(np.concatenate((shared, own(100)))) for _ in range(2))
        s = near_dup.signatures(np.array([0, len(a), len(a) + len(b)]), np.concatenate((a, b)))
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - 0.75) < 0.03
    tiny = near_dup.signatures(np.array([0, 1]), np.array([5], np.uint64))
    assert (tiny != 0).all()


def test_language_model(docs, texts):
    """Counts, base scores and scores of a trigram model counted here; weights by the operator's EM and by a plain one."""
    tokens = {i: [*words(lower(t)), None] for i, t in texts.items()}
    crc = {i: zlib.crc32(str(i).encode()) for i in texts}
    train = [i for i in texts if crc[i] % 5 != 1]

    def counted(ids):
        one = Counter(w for i in ids for w in tokens[i])
        two = Counter(p for i in ids for p in zip(["<s>", *tokens[i]], tokens[i]))
        three = Counter(p for i in ids for p in zip(["<s>", *tokens[i]], tokens[i], tokens[i][1:]))
        last = Counter(w for i in ids for w in ["<s>", *tokens[i][:-1]])
        return one, two, three, last, sum(one.values())

    def looks(i, counts):
        """(history count, last word's count, shares by trigram, bigram, unigram) of each token."""
        one, two, three, last, n = counts
        t = ["<s>", *tokens[i]]
        for k in range(1, len(t)):
            h = two[t[k - 2], t[k - 1]] if k > 1 else last["<s>"]
            pair = two[t[k - 1], t[k]]
            yield h, last[t[k - 1]], (three[tuple(t[k - 2 : k + 1])] if k > 1 else pair, h), (pair, last[t[k - 1]]), (one[t[k]], n)

    full, gone = counted(train), [i for i in train if crc[i] // 5 % 10 == 0]
    kept = counted([i for i in train if i not in gone])
    c, v, n = full[0], len(full[0]), full[4]
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, 20_000).collect()}
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc[i] % 5 == 1, len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs=1e-6)
    level = lambda h, o: int(math.log2(h)) + 1 if h else lm.LEVELS + (int(math.log2(o)) + 1 if o else 0)
    quant = lambda x, of: int(lm.code(np.array([x]), np.array([of]))[0])
    seen, keys = {}, Counter()
    for i in gone:
        for k, (h, o, *shares) in enumerate(looks(i, kept)):
            if k:  # a document's first token has no trigram to learn from
                seen.setdefault(level(h, o), []).append([a / b if b else 0 for a, b in shares] + [1 / (v + 1)])
                keys[level(h, o) | sum(quant(*s) << m for s, m in zip(shares, (24, 16, 8)))] += 1
    ks = np.array(sorted(keys))
    weights = lm.expectation_maximisation(ks, np.array([keys[k] for k in ks], float), v)
    overall = em(np.array([x for s in seen.values() for x in s]), np.full(4, 0.25))
    plain = {k: em(np.array(s), overall) for k, s in seen.items()}
    for i, t in tokens.items():
        same = near = 0.0
        for h, o, *shares in looks(i, full):
            p = np.array([a / b if b else 0 for a, b in shares] + [1 / (v + 1)])
            same += math.log10(weights[level(h, o)] @ p)
            near += math.log10(plain.get(level(h, o), overall) @ p)
        assert got[i]["score"] == pytest.approx(same, abs=1e-6 * len(t))
        assert abs(got[i]["score"] - near) < 0.03 * len(t)


def test_histograms_pack():
    keys, weight = np.array([5, 9, 5, 1 << 30]), np.array([1, 2, 3, 4])
    k, w = lm.unpack_histograms([lm.pack_histogram(keys, weight), lm.pack_histogram(keys[:0], weight[:0])])
    assert dict(zip(k.tolist(), w.tolist())) == {5: 4, 9: 2, 1 << 30: 4}


def em(p, a, rounds=60):
    for _ in range(rounds):
        s = p * a
        s /= s.sum(axis=1, keepdims=True)
        a = s.sum(axis=0) / s.sum()
    a = np.maximum(a, 1e-6)
    return a / a.sum()


def test_beta_quantiles(spark):
    from panelforge.llm.url_filter import beta_quantile

    rng = np.random.default_rng(2)
    cases = [(1.0, 1.0), (0.5, 0.5), (0.05, 3.0), (30.0, 2.0), (500.0, 400.0), (2.0, 0.1), (1e-3, 5.0)]
    got = spark.createDataFrame(cases, "a double, b double").select("a", "b", beta_quantile(F.col("a"), F.col("b"), 0.95).alias("q")).collect()
    for r in got:
        want = np.quantile(rng.beta(r["a"], r["b"], 400_000), 0.95)
        assert r["q"] == pytest.approx(want, abs=0.006)


def test_reputation_blocks_bad_hosts(spark):
    from panelforge.llm.url_filter import filter_urls

    urls = [f"http://h{k}.net/{i}" for k in range(20) for i in range(40)]
    good = [int(not (k == 3 and i > 2)) for k in range(20) for i in range(40)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = filter_urls(pages, spark.createDataFrame(list(zip(urls, good)), "url string, good int"))
    assert {r["host"] for r in got.where("verdict = 'block'").collect()} == {"h3.net"}
    assert op6_host_reputation(spark, DATA).count() == read(spark, DATA, "pages").count()


def test_pipeline(spark, docs):
    """Each stage against its brute-force version on its own input."""
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]
    frame = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, DATA).cache()
        if name != "BPE encoding and decoding":
            assert out.columns == docs.columns
        seen.append((name, {r["doc_id"]: r["text"] for r in frame.collect()}, out))
        frame = out
    # Quality: the score of each text from the fitted machine, feature by feature.
    _, before, after = seen[0]
    chars = {r["doc_id"]: r["n_chars"] for r in docs.collect()}
    m = fm.fit(docs, read(spark, DATA, "labels").where(common.crc_of_id() % 4 != 2))
    score = {r["doc_id"]: r["score"] for r in fm.quality_scores(docs, read(spark, DATA, "labels")).collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i in before if score[i] >= 0.7}
    for i, t in list(before.items())[:40]:
        bounds, keys = fm.bag(pa.array([t or ""]), m.bits)
        d = np.clip((fm.dense(pa.array([t or ""]), np.array([float(chars[i])])) - m.mean) / m.scale, -8, 8)
        x = np.concatenate((np.zeros(1 << m.bits), d[0]))
        x[keys] = 1 / math.sqrt(max(len(keys), 1))
        some = np.flatnonzero(x)
        pairs = sum(float(m.v[a] @ m.v[b]) * x[a] * x[b] for k, a in enumerate(some) for b in some[:k]) if len(some) < 150 else None
        if pairs is not None:
            assert score[i] == pytest.approx(1 / (1 + math.exp(-(m.w0 + m.w @ x + pairs))), abs=1e-6)
    _, before, after = seen[2]
    first, n = {}, 13
    for i in sorted(before):
        for k in range(len(words(before[i])) - n + 1):
            first.setdefault(tuple(words(before[i])[k : k + n]), i)
    for r in after.collect():
        w = words(before[r["doc_id"]])
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < r["doc_id"] for j in range(n)}
        assert words(r["text"]) == [x for k, x in enumerate(w) if k not in gone]
    _, before, after = seen[1]
    near = brute_near(before)
    assert {r["doc_id"] for r in after.collect()} == {i for i in before if near[i][1] == i}
    _, before, after = seen[3]
    items = [words(r["text"]) for r in read(spark, DATA, "benchmark").collect()]
    held = {i for i, t in before.items() for x in items if " ".join(x) in " ".join(words(t))}
    stay = {r["doc_id"] for r in after.collect()}
    assert not held & stay
    # What goes has an item's passage of 13 words' worth, or half an item, by plain alignment.
    fold = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", lower(t)).split()
    for i in before.keys() - stay:
        number = {w: k for k, w in enumerate(dict.fromkeys(w for x in items for w in fold(" ".join(x))))}
        d = np.array([[number.get(w, -1) for w in fold(before[i])]])
        best = [(int(decontam.align(np.array([number[w] for w in fold(" ".join(x))]), d)[0][0]), len(fold(" ".join(x)))) for x in items]
        assert any(b >= min(k, 26) for b, k in best)
    t = bpe.tokenizer(bpe.default_path())
    _, before, after = seen[4]
    for r in after.collect():
        assert r["ids_sha256"] == hashlib.sha256(np.array(t.encode(before[r["doc_id"]], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()

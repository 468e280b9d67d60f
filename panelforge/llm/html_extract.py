"""HTML extraction by equivalence-class template deduction.

1. A page is read into tokens: tags by the path they stand on (names, classes, ids), and
   text runs by path and content.  Over the pages of a host each token has an occurrence
   vector.  Vectors are never held: a token's is summed up as (pages with it, sum of page
   hashes times occurrences), which merge in any order, so a host with a third of all
   pages is pre-aggregated like any other.  With it go the mean length of the text below a
   tag, and 64 bits of which residues of the page's content it was seen with.
2. Tokens of one host with equal vectors form an equivalence class.  A class is valid if
   it has two tokens, a tag among them that stands once on each of its pages, and pages of
   ``least`` different contents: copies of one article make no template.  There is no
   fixed share of the host, so each page design has its own classes.
3. Paths nest: a class stands in the slot that a tag of the enclosing class opens.  A
   page's template is followed from its root: at each step into the slot with the longest
   mean text among the page's template tags there, while that holds at least ``share`` of
   what stands there.  The last slot so reached holds the main text.
4. In it, text runs of valid classes (the same on all pages of a class) are template too
   and fall out, unless they are over three quarters of the page's main text, which is then
   a page of near copies.  Elements that HTML names as menu, form, aside, script and the
   like fall out; those that only a class, id or role marks as such (MARKS) stay where the
   host's pages show them to hold a main part of the text.
5. The text runs that remain are joined to blocks in page order.

On a page without a valid class (a host of fewer than ``least`` different pages) the
article or main element, where there is one, stands for the main slot, else the body.
Where templates reach only the body and the page has one article or main element, that
is the tie-break too.

Templates are sent to the tasks if their checked size is below ``broadcast_bytes``,
else pages and templates are joined by host.

Defined results: null or empty html gives empty text; malformed markup closes what it
can (a block-level tag ends an open paragraph, unclosed elements end with their
parents); character references are decoded once; repeated pages and pages that share an
id are extracted each, a null page_id or url is kept as it is; a very long page is read
whole; among equally long slots the first on the page is taken; other columns are not
read; empty tables give empty results.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces
from .url_filter import with_host

SCHEMA = "page_id long, url string, text string, n_chars long"
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
UNSEEN = frozenset(("script", "style", "noscript", "template"))  # they part no text
DROP = frozenset(
    "head nav header footer aside form script style textarea title noscript template iframe svg math canvas object audio video select button dialog menu fieldset noembed noframes datalist map".split()
)
NEVER_DROP = frozenset(("html", "body", "main"))
#: Words of a class, id or role that mark what is not the article.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs
    sidebar aside footer header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup login
    share sharing social related recommended recommendations widget comment comments reply replies disqus discussion respond toolbar pagination
    pager tags taglist skip hidden complementary contentinfo search outbrain taboola paywall disclaimer""".split()
)
#: Words that go with one of MARKS in a name, as in ``ad-box``; any other word makes the name one of content.
FILLERS = frozenset("area bar block bottom box button buttons container content footer form group header holder inner item items left link links list main panel right section slot top unit wrap wrapper".split())
REPLIES = frozenset(("comment", "comments", "reply", "replies", "response", "responses"))
ROOTS = frozenset(("article", "main"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


def _names(value: str) -> tuple[bool, bool]:
    """Whether a class or id marks what is not content, and whether it marks comments."""
    bad = reply = False
    for name in value.split():
        parts = _WORD.findall(name)
        hit = [x for x in parts if x in MARKS]
        if hit and all(x in MARKS or x in FILLERS or x.isdigit() for x in parts):
            bad = True
            reply |= any(x in REPLIES for x in hit)
    return bad, reply


def _marked(attributes: str) -> tuple[int, bool, bool, str]:
    """(0 content, 1 marked as none, 2 hidden or of another role; marks comments; is the main role; class and id for the path)."""
    if not attributes or attributes.isspace():
        return 0, False, False, ""
    bad, reply, main, label = 0, False, False, ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            bad = 2
        elif name == "role":
            main |= value in ("main", "article")
            if value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"):
                bad = 2
        elif name in ("class", "id"):
            label += "." + value
            marked, comment = _names(value)
            bad, reply = max(bad, int(marked)), reply | comment
    return bad, reply, main, label


@dataclass
class Page:
    """Elements in page order (path, parent, name, kind of drop, is a root) and text runs (block, text, element)."""

    path: list[int] = field(default_factory=lambda: [0])
    parent: list[int] = field(default_factory=lambda: [-1])
    name: list[str] = field(default_factory=lambda: [""])
    drop: list[int] = field(default_factory=lambda: [0])
    root: list[bool] = field(default_factory=lambda: [False])
    runs: list[tuple[int, str, int]] = field(default_factory=list)


def _hash(text: str, seed: int = 0) -> int:
    raw = text.encode(errors="replace")
    return (zlib.crc32(raw, seed) << 31) | (zlib.crc32(raw, seed + 7) >> 1)


def read_page(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, element, inside a root
    block, at, n = 0, 0, len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        if m is None:
            break
        at, name = m.end(), m[2]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                page.runs.append((block, entities.unescape(piece), stack[-1][1]))
            elif piece.startswith("<![CDATA["):
                page.runs.append((block, piece[9:].removesuffix("]]>"), stack[-1][1]))
            continue
        name = name.lower()
        inline = name in INLINE or name in UNSEEN
        if not inline:
            block += 1
        if m[1]:  # an end tag closes its element and what is open inside
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if inline and stack[k][0] not in INLINE:
                    break
            continue
        if not inline:  # a block-level start ends open inline elements and an open paragraph
            while len(stack) > 1 and name != "br" and (stack[-1][0] in INLINE or (stack[-1][0] == "p" and name not in VOID) or (stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"))):
                stack.pop()
        if name in VOID:
            continue
        _, parent, inside = stack[-1]
        bad, reply, main, label = _marked(m[3])
        # A header inside the article is part of it, with the rest of the rules in force.
        fixed = (name in DROP and not (inside and name == "header")) or bad == 2 or (name == "article" and reply)
        page.path.append(_hash(f"{page.path[parent]}/{name}{label}"))
        page.parent.append(parent)
        page.name.append(name)
        page.drop.append(0 if name in NEVER_DROP else 2 if fixed else 0 if name in ROOTS else bad)
        page.root.append(name in ROOTS or main)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if m[3].endswith("/") and name in ("svg", "path"):
            continue
        stack.append((name, len(page.path) - 1, inside or page.root[-1]))
    return page


def _fold(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def _gone(page: Page) -> list[bool]:
    """Which elements HTML itself keeps out of the main text, with what is inside them."""
    out: list[bool] = []
    for k, parent in enumerate(page.parent):
        out.append(page.drop[k] == 2 or (parent >= 0 and out[parent]))
    return out


def _mass(page: Page, gone: list[bool]) -> list[int]:
    """Characters of text below each element."""
    out = [0] * len(page.path)
    for _, text, k in page.runs:
        if not gone[k]:
            out[k] += len(_fold(text))
    for k in range(len(out) - 1, 0, -1):
        out[page.parent[k]] += out[k]
    return out


def _run_token(page: Page, text: str, k: int) -> int:
    return (1 << 63) | (_hash(f"{page.path[k]}|{text}") >> 1)


#: token -> [occurrences, length of the text below or -1 for a text run]
def page_tokens(page: Page) -> tuple[dict[int, list[int]], int]:
    """Occurrences and mass of each token of a page, and a hash of its longest texts."""
    gone = _gone(page)
    mass = _mass(page, gone)
    found: dict[int, list[int]] = {}
    for k, path in enumerate(page.path):
        slot = found.setdefault(path, [0, 0])
        slot[0] += 1
        slot[1] += mass[k]
    texts = []
    for _, text, k in page.runs:
        if not gone[k] and (t := _fold(text)):
            texts.append(t)
            found.setdefault(_run_token(page, t, k), [0, -1])[0] += 1
    texts.sort(key=lambda t: (-len(t), t))
    return found, _hash("\n".join(texts[:3]))


@dataclass
class Template:
    """Of one host: mean text below each tag token, the tags of valid classes, and the text runs of such."""

    mean: dict[int, float] = field(default_factory=dict)
    tags: frozenset = frozenset()
    texts: frozenset = frozenset()


def main_slot(page: Page, template: Template, mass: list[int], gone: list[bool], share: float) -> int:
    """The element that holds the main text."""
    children: dict[int, list[int]] = {}
    for k in range(1, len(page.path)):
        children.setdefault(page.parent[k], []).append(k)
    at, followed = 0, False
    once: dict[int, int] = {}
    for p in page.path:
        once[p] = once.get(p, 0) + 1
    while True:
        here = [k for k in children.get(at, []) if not gone[k]]
        known = [k for k in here if page.path[k] in template.tags and once[page.path[k]] == 1]
        if not known:
            break
        best = max(known, key=lambda k: template.mean[page.path[k]])
        # All that stands here: what the host's pages have below each tag of this page, this page's own text elsewhere.
        total = sum(template.mean.get(p, 0.0) for p in {page.path[k] for k in here}) or 1.0
        if template.mean[page.path[best]] < share * total:
            break
        at, followed = best, True
    roots = [k for k in range(1, len(page.path)) if page.root[k] and not gone[k] and mass[k]]
    outer = [k for k in roots if not any(_below(page, k, r) for r in roots if r != k)]
    if outer and (not followed or page.name[at] in ("", "html", "body")):
        inside = [k for k in outer if _below(page, k, at)]
        return inside[0] if len(inside) == 1 else at if inside else outer[0]
    return at


def _below(page: Page, k: int, top: int) -> bool:
    while k > top:
        k = page.parent[k]
    return k == top


def blocks(source: str, template: Template | None = None, share: float = 0.5) -> list[str]:
    """The main text of a page: folded blocks of its main slot."""
    page, template = read_page(source), template or Template()
    gone = _gone(page)
    mass = _mass(page, gone)
    slot = main_slot(page, template, mass, gone, share)
    outer = [k for k in range(len(page.path)) if page.root[k] and not gone[k] and mass[k] and _below(page, k, slot)] if page.name[slot] in ("", "html", "body") else []
    several = set(outer)  # a page of several articles, where nothing else tells the slot
    whole = template.mean.get(page.path[slot], float(mass[slot])) or 1.0
    inside = [False] * len(page.path)
    for k in range(len(page.path)):
        parent = page.parent[k]
        up = k == slot if not several else k in several
        ok = up or (parent >= 0 and inside[parent])
        # A class or id marks it, and the host's pages don't show it as a main part.
        marked = page.drop[k] == 1 and k != slot and template.mean.get(page.path[k], 0.0) < share * whole
        inside[k] = ok and not gone[k] and not marked
    runs = [(b, t, k) for b, t, k in page.runs if inside[k]]
    if template.texts:
        own = [bool(f) and _run_token(page, f, k) not in template.texts for f, k in ((_fold(t), k) for _, t, k in runs)]
        lost = sum(len(t) for (_, t, _), x in zip(runs, own, strict=True) if not x and t.strip())
        if 4 * lost <= 3 * sum(len(t) for _, t, _ in runs):
            runs = [r for r, x in zip(runs, own, strict=True) if x or r[1].isspace()]
    out: list[str] = []
    last, parts = None, []
    for b, text, _ in [*runs, (None, "", 0)]:
        if b != last:
            if t := _fold("".join(parts)):
                out.append(t)
            last, parts = b, []
        parts.append(text)
    return out


TOKENS = "host string, token long, n long, vector decimal(38,0), once boolean, mass long, seen long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def host_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, n, vector, once, mass, seen): occurrence vectors of tokens, summed up."""

    def each(batches):
        total: dict[tuple[str, int], list] = {}

        def flush():
            keys, rows = list(total), list(total.values())
            total.clear()
            cols = [[r[k] for r in rows] for k in range(5)]
            kinds = [pa.int64(), pa.decimal128(38, 0), pa.bool_(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([_signed(k[1]) for k in keys], pa.int64()), *[pa.array([_signed(x) for x in c] if n == 4 else c, t) for n, (c, t) in enumerate(zip(cols, kinds, strict=True))]],
                ["host", "token", "n", "vector", "once", "mass", "seen"],
            )

        for batch in batches:
            for part in pieces(batch, "html"):
                for host, page_id, source in zip(part.column("host").to_pylist(), part.column("page_id").to_pylist(), part.column("html").to_pylist(), strict=True):
                    found, content = page_tokens(read_page(source or ""))
                    of_page = _hash(f"{page_id}|{content}")
                    for token, (k, mass) in found.items():
                        row = total.setdefault((host, token), [0, 0, True, 0, 0])
                        row[0] += 1
                        row[1] += of_page * k
                        row[2] &= k == 1
                        row[3] += mass
                        row[4] |= 1 << (content & 63)
                    if len(total) > 200_000:
                        yield flush()
        yield flush()

    made = pages.select("host", "page_id", "html").mapInArrow(each, TOKENS)
    return made.groupBy("host", "token").agg(F.sum("n").alias("n"), F.sum("vector").alias("vector"), F.bool_and("once").alias("once"), F.sum("mass").alias("mass"), F.bit_or("seen").alias("seen"))


def templates(pages: DataFrame, least: int = 3) -> DataFrame:
    """(host, token, kind, mean): 1 tags of valid classes, 2 text runs of valid classes, 0 other tags."""
    tokens = host_tokens(pages).where((F.col("n") >= least) & (F.bit_count("seen") >= least)).withColumn("tag", F.col("mass") >= 0)
    # Equal vectors: equal page counts and equal sums.  Class by class in partial sums; no class is held in one place.
    classes = tokens.groupBy("host", "n", "vector").agg(F.count("*").alias("size"), F.bool_or(F.col("tag") & F.col("once")).alias("stands"))
    valid = (F.col("size") >= 2) & F.col("stands")
    kind = F.when(F.col("tag"), F.when(valid & F.col("once"), 1).otherwise(0)).when(valid & F.col("once"), 2)
    return tokens.join(classes, ["host", "n", "vector"]).select("host", "token", kind.alias("kind"), F.when(F.col("tag"), F.col("mass") / F.col("n")).alias("mean")).where("kind is not null")


def _template(rows) -> Template:
    unsigned = lambda x: int(x) & ((1 << 64) - 1)
    rows = [(unsigned(t), k, m) for t, k, m in rows]
    return Template({t: m for t, k, m in rows if k < 2}, frozenset(t for t, k, _ in rows if k == 1), frozenset(t for t, k, _ in rows if k == 2))


def _extract_rows(ids, urls, sources, found, share: float) -> pa.RecordBatch:
    texts = ["\n".join(blocks(s, t, share)) if s else "" for s, t in zip(sources, found, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
    )


def extract(pages: DataFrame, share: float = 0.5, least: int = 3, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    hosted = with_host(pages.select("page_id", "url", "html"))
    found = materialise(templates(hosted.select("host", "page_id", "html"), least), "templates")
    size = found.agg(F.sum(F.lit(24) + F.octet_length("host"))).first()[0] or 0
    if size <= broadcast_bytes:
        rows: dict[str, list] = {}
        for r in found.toLocalIterator():
            rows.setdefault(r["host"], []).append((r["token"], r["kind"], r["mean"]))
        known = {h: _template(x) for h, x in rows.items()}

        def each(batches):
            for batch in batches:
                for part in pieces(batch, "html"):
                    hosts = part.column("host").to_pylist()
                    yield _extract_rows(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").to_pylist(), [known.get(h) for h in hosts], share)

        return hosted.select("page_id", "url", "html", "host").mapInArrow(each, SCHEMA)

    def joined(batches):
        last, made = None, None
        for batch in batches:
            for part in pieces(batch, "html"):
                out = []
                for x in part.column("template"):
                    if not x.is_valid:
                        out.append(None)
                        continue
                    if last is None or not x.equals(last):
                        last, made = x, _template([(t["token"], t["kind"], t["mean"]) for t in x.as_py()])
                    out.append(made)
                yield _extract_rows(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").to_pylist(), out, share)

    # A host's template is one row, its pages are many: salted, so that no host is one task's.
    salts = 16
    per_host = found.groupBy("host").agg(F.collect_list(F.struct("token", "kind", "mean")).alias("template"))
    per_host = per_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = hosted.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    return salted.join(per_host, ["host", "_salt"], "left").select("page_id", "url", "html", "template").mapInArrow(joined, SCHEMA)

"""The registered queries of the corpus operators: thin digests over their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fm, html_extract, lm, near_dup, quality_rules, substring_dedup, toxicity, url_filter
from .common import read


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page's url ends in the id of the document it shows; ``labels`` grades some of those."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    shown = F.regexp_extract("url", "/([0-9]+)(?:/|\\.html)?(?:[?#].*)?$", 1).try_cast("long")
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("good"))
    outcomes = pages.select("url", shown.alias("doc_id")).join(labels, "doc_id").select("url", "good")
    out = url_filter.filter_urls(pages, outcomes)
    return out.withColumns({c: F.round(c, 6) for c in ("reputation", "upper_bound")})


def op2_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(read(spark, sf_dir, "documents"))


def op3_template_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_seed_and_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op10_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_robust_outliers": op1_robust_outliers,
    "op2_phrase_automata": op2_phrase_automata,
    "op3_template_classes": op3_template_classes,
    "op4_ordinal_toxicity": op4_ordinal_toxicity,
    "op5_chunk_reuse": op5_chunk_reuse,
    "op6_host_reputation": op6_host_reputation,
    "op7_factorisation_machine": op7_factorisation_machine,
    "op8_seed_and_align": op8_seed_and_align,
    "op9_near_dedup": op9_near_dedup,
    "op10_deleted_interpolation": op10_deleted_interpolation,
}
_WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS u, b.rep AS v FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
b AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r AS (SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, b.v FROM r JOIN b ON r.seen = b.u),
k AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.component, s.doc_id) AS component_id,
       coalesce(k.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN k ON k.node = c.rep
"""

OP2_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
h AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM g),
m AS (SELECT g, min(doc_id) AS low FROM h GROUP BY g),
r AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 13)) AS p FROM h JOIN m ON h.g = m.g AND h.doc_id > m.low),
a AS (SELECT doc_id, list(p) AS p FROM r GROUP BY doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM w),
k AS (SELECT x.doc_id, string_agg(x.t, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN r ON x.doc_id = r.doc_id AND x.i = r.p GROUP BY x.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(a.p), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON a.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""



def _strength_sql(spread: str, size: str, degrees: str, above: str) -> str:
    share = f"(({spread} - m * (1 - m) * {degrees}) / {size} / (m * (1 - m)))"
    return f"CASE WHEN {degrees} = 0 THEN {above} WHEN {size} > 0 AND m > 0 AND m < 1 AND {share} > 0 THEN least(1000, greatest(0.5, 1 / {share} - 1)) ELSE 1000 END"


_LONG = ", ".join(f"'{x}'" for x in url_filter.LONG_SUFFIXES)
_FITS = [(a, t, *t.partition("/")[::2]) for a, t in sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[0] != "block"))]
_CASE = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{q}') THEN '{(a, t)[out]}'" for a, t, h, q in _FITS) + " END"
_log_t = lambda s: f"(CASE WHEN {s} >= 0 THEN -ln(1 + exp(-{s})) ELSE {s} - ln(1 + exp({s})) END)"
OP6_SQL = rf"""
WITH r AS (SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
 try_cast(nullif(regexp_extract(url, '/([0-9]+)(?:/|\.html)?(?:[?#].*)?$', 1), '') AS BIGINT) AS shown FROM r),
l AS (SELECT doc_id, max(quality) AS good FROM labels GROUP BY 1),
c AS (SELECT host, count(*) AS n, sum(good) AS s FROM p JOIN l ON shown = doc_id WHERE good IS NOT NULL GROUP BY 1),
x AS (SELECT host, string_split(host, '.') AS a FROM (SELECT DISTINCT host FROM p)),
y AS (SELECT host, a, array_to_string(a[greatest(len(a) - 1, 1):], '.') AS two FROM x),
h AS (SELECT y.host, CASE WHEN two IN ({_LONG}) THEN array_to_string(a[greatest(len(a) - 2, 1):], '.') ELSE two END AS domain,
 CASE WHEN two IN ({_LONG}) THEN two ELSE a[len(a)] END AS suffix, coalesce(n, 0)::DOUBLE AS n, coalesce(s, 0)::DOUBLE AS s FROM y LEFT JOIN c USING (host)),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(s) AS ds, count(*) FILTER (n > 0) AS dk, sum(n * n) AS dsq FROM h GROUP BY ALL),
u AS (SELECT suffix, sum(dn) AS un, sum(ds) AS us, count(*) FILTER (dn > 0) AS uk, sum(dn * dn) AS usq FROM d GROUP BY ALL),
g AS (SELECT sum(un) AS total, CASE WHEN sum(un) > 0 THEN sum(us) / sum(un) ELSE 1 END AS m, sum(uk - (un > 0)::INT) AS dk, sum(coalesce(usq / nullif(un, 0), 0)) AS dq,
 greatest(count(*) FILTER (un > 0) - 1, 0) AS k, coalesce(sum(un * un) / nullif(sum(un), 0), 0) AS uq FROM u),
e AS (SELECT (SELECT sum(coalesce(n * pow(s / nullif(n, 0) - ds / nullif(dn, 0), 2), 0)) FROM h JOIN d USING (domain, suffix)) AS hs,
 (SELECT sum(coalesce(dn * pow(ds / nullif(dn, 0) - us / nullif(un, 0), 2), 0)) FROM d JOIN u USING (suffix)) AS dv,
 (SELECT sum(dk - (dn > 0)::INT) FROM d) AS hk, (SELECT sum(coalesce(dsq / nullif(dn, 0), 0)) FROM d) AS hq,
 (SELECT sum(coalesce(un * pow(us / nullif(un, 0) - m, 2), 0)) FROM u) AS uv, g.* FROM g),
k1 AS (SELECT *, {_strength_sql("uv", "(total - uq - k)", "k", "10")} AS ku FROM e),
k2 AS (SELECT *, {_strength_sql("dv", "(total - dq - dk)", "dk", "ku")} AS kd FROM k1),
k3 AS (SELECT *, {_strength_sql("hs", "(total - hq - hk)", "hk", "kd")} AS kh FROM k2),
b1 AS (SELECT h.*, dn, ds, m, ku, kd, kh, (us - ds + ku * m) / (un - dn + ku) AS m1 FROM h JOIN d USING (domain, suffix) JOIN u USING (suffix), k3),
b2 AS (SELECT *, (ds - s + kd * m1) / (dn - n + kd) AS m2 FROM b1),
b3 AS (SELECT host, n, s, s + kh * m2 AS a, n - s + kh * (1 - m2) AS b FROM b2),
q0 AS (SELECT host, greatest(a, 1e-3) AS a, greatest(b, 1e-3) AS b FROM b3),
q1 AS (SELECT *, ln(a / b) AS peak, sqrt(1 / a + 1 / b) AS width, least(sqrt(1 / a + 1 / b), 1) AS sc FROM q0),
qr AS (SELECT *, asinh((8 * width + 40 / least(a, b)) / sc) AS reach FROM q1),
q2 AS (SELECT *, 2 * reach / {url_filter.NODES} AS step, k * (2 * reach / {url_filter.NODES}) - reach AS u FROM qr, range({url_filter.NODES + 1}) r(k)),
q3 AS (SELECT *, peak + sc * sinh(u) AS t FROM q2),
q4 AS (SELECT host, k, u, step, reach, peak, sc, exp((a + b) * {_log_t("t")} - b * t - ((a + b) * {_log_t("peak")} - b * peak)) * cosh(u) AS w FROM q3),
q5 AS (SELECT *, coalesce((w + lag(w) OVER (PARTITION BY host ORDER BY k)) / 2, 0) AS part FROM q4),
q6 AS (SELECT *, sum(part) OVER (PARTITION BY host ORDER BY k) AS run, sum(part) OVER (PARTITION BY host) AS total FROM q5),
q7 AS (SELECT host, any_value(peak) AS peak, any_value(sc) AS sc, coalesce(arg_min(u - step + step * (0.95 * total - (run - part)) / part, k) FILTER (k > 0 AND run >= 0.95 * total), any_value(reach)) AS u FROM q6 GROUP BY host),
b AS (SELECT host, n::BIGINT AS host_labelled, s::BIGINT AS host_good, b3.a / (b3.a + b3.b) AS reputation, 1 / (1 + exp(-(peak + sc * sinh(u)))) AS upper_bound FROM b3 JOIN q7 USING (host))
SELECT page_id, p.host, path, {_CASE(1)} AS rule, coalesce({_CASE(0)}, CASE WHEN upper_bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
 host_labelled, host_good, round(reputation, 6) AS reputation, round(upper_bound, 6) AS upper_bound FROM p JOIN b ON p.host = b.host
""".replace("(host = ", "(p.host = ").replace("ends_with(host,", "ends_with(p.host,")

ORACLES: dict[str, str] = {"op6_host_reputation": OP6_SQL, "op2_phrase_automata": OP2_SQL, "op9_near_dedup": OP9_SQL}

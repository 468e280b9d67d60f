"""URL filters: allow and block rules, and a host reputation where no rule fits.

DataFrame functions only.  Outcomes of labelled pages (1 good, 0 bad) are counted per
host; each level of host, registered domain, suffix is shrunk toward the level above
through a beta-binomial prior whose strength comes from the variance between its
members (method of moments).  A page without a rule is blocked if the upper posterior
bound of its host's share of good pages, a quantile of its beta posterior, lies below
``floor``.

Counts are summed before any join, so a host with a third of all pages is one row.

Defined results: a null url or one without ``://`` has an empty host and path, which
form a host of their own.  Null outcomes don't count.  Without any outcome everything
unruled is allowed.  Repeated pages, and pages without an id, are judged one by one; of
equally long rules that fit, a blocking one counts; a very long url is read whole; other
columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (action, host and path): a rule fits its host and all subdomains below its path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which domains are registered; fixed values.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "org.au", "org.uk")
MAX_STRENGTH, MIN_STRENGTH, PLAIN_STRENGTH = 1000.0, 0.5, 10.0


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise(F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; ties go to block."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _levels(suffixes) -> tuple[Column, Column]:
    labels = F.split("host", "\\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    long = two.isin(*suffixes)
    take = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - F.lit(k - 1), F.lit(1)), k), ".")
    return F.when(long, take(3)).otherwise(take(2)), F.when(long, take(2)).otherwise(take(1))


def _strength(row, s: str, n: str, sq: str, k: str, above: float) -> float:
    """Prior strength from the spread of the members about their parents; where no parent has two, that of the level above."""
    if not row[k]:
        return above
    p = row["good"] / row["total"] if row["total"] else 0.5
    spread, size, degrees = row[s] or 0.0, (row[n] or 0.0) - (row[sq] or 0.0) - (row[k] or 0.0), row[k] or 0.0
    between = (spread - p * (1 - p) * degrees) / size if size > 0 else 0.0
    share = between / (p * (1 - p)) if 0 < p < 1 else 0.0
    return min(MAX_STRENGTH, max(MIN_STRENGTH, 1 / share - 1)) if share > 0 else MAX_STRENGTH


#: Nodes of the posterior's integral.
NODES = 192


def beta_quantile(a: Column, b: Column, p: float) -> Column:
    """Quantile ``p`` of a beta distribution, by the trapezoid rule over the logit.

    On that scale the density has no poles and falls off exponentially on both sides, so
    nodes that spread like sinh about its peak, as close there as the density is narrow
    and as far out as its tails are long, cover it for any a, b of 0.001 and more (smaller
    ones are taken as that).
    """
    a, b = F.greatest(a, F.lit(1e-3)), F.greatest(b, F.lit(1e-3))
    peak, width = F.log(a / b), F.sqrt(1 / a + 1 / b)
    scale = F.least(width, F.lit(1.0))
    reach = F.asinh((8 * width + 40 / F.least(a, b)) / scale)
    step = 2 * reach / NODES
    log_t = lambda s: F.when(s >= 0, -F.log1p(F.exp(-s))).otherwise(s - F.log1p(F.exp(F.least(s, F.lit(0.0)))))
    height = lambda s: (a + b) * log_t(s) - b * s
    weight = lambda u: F.exp(height(peak + scale * F.sinh(u)) - height(peak)) * F.cosh(u)
    nodes = F.transform(F.sequence(F.lit(0), F.lit(NODES)), lambda k: weight(k * step - reach))

    def walk(s, w):
        part = (s["last"] + w) / 2
        here = F.when(s["u"].isNull() & (s["sum"] + part >= s["goal"]), s["at"] + s["step"] * (s["goal"] - s["sum"]) / part).otherwise(s["u"])
        return F.struct((s["sum"] + part).alias("sum"), w.alias("last"), here.alias("u"), (s["at"] + s["step"]).alias("at"), s["step"].alias("step"), s["goal"].alias("goal"))

    def place(n):
        total = F.aggregate(n, F.lit(0.0), lambda s, w: s + w) - (F.element_at(n, 1) + F.element_at(n, NODES + 1)) / 2
        start = F.struct(F.lit(0.0).alias("sum"), F.element_at(n, 1).alias("last"), F.lit(None).cast("double").alias("u"), (-reach).alias("at"), step.alias("step"), (F.lit(p) * total).alias("goal"))
        return F.aggregate(F.slice(n, 2, NODES), start, walk)["u"]

    # In a lambda of its own the nodes are one value, computed once a row.
    u = F.coalesce(F.element_at(F.transform(F.array(nodes), place), 1), reach)
    return 1 / (1 + F.exp(-(peak + scale * F.sinh(u))))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, level: float = 0.95, suffixes=LONG_SUFFIXES) -> DataFrame:
    """Posterior of each host: ``outcomes`` has host and good (0, 1, null), ``hosts`` distinct hosts."""
    domain, suffix = _levels(suffixes)
    h = hosts.join(outcomes.where(F.col("good").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("s")), "host", "left")
    h = h.select("host", domain.alias("domain"), suffix.alias("suffix"), F.coalesce("n", F.lit(0)).cast("double").alias("n"), F.coalesce("s", F.lit(0)).cast("double").alias("s"))
    # One row a host, written once: all that follows reads that table, not the pages.
    h = materialise(h, "hosts")
    d = h.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("s").alias("ds"), F.count_if(F.col("n") > 0).alias("dk"), F.sum(F.col("n") * F.col("n")).alias("dsq"))
    u = d.groupBy("suffix").agg(F.sum("dn").alias("un"), F.sum("ds").alias("us"), F.count_if(F.col("dn") > 0).alias("uk"), F.sum(F.col("dn") * F.col("dn")).alias("usq"))

    def about(n: str, s: str, pn: str, ps: str) -> Column:
        gap = F.try_divide(F.col(s), F.col(n)) - F.try_divide(F.col(ps), F.col(pn))
        return F.sum(F.coalesce(F.col(n) * gap * gap, F.lit(0.0)))

    # One row of sums for the three strengths; each is a plain aggregate.
    hd = h.join(d.drop("suffix"), "domain").agg(about("n", "s", "dn", "ds").alias("hs")).first()
    du = d.join(u, "suffix").agg(about("dn", "ds", "un", "us").alias("ds_"), F.sum(F.col("dk") - (F.col("dn") > 0).cast("int")).alias("hk"), F.sum(F.coalesce(F.try_divide("dsq", "dn"), F.lit(0.0))).alias("hq")).first()
    g = u.agg(F.sum("un").alias("total"), F.sum("us").alias("good"), F.sum(F.col("uk") - (F.col("un") > 0).cast("int")).alias("dk"), F.sum(F.coalesce(F.try_divide("usq", "un"), F.lit(0.0))).alias("dq"), F.sum(F.col("un") * F.col("un")).alias("sq"), F.count_if(F.col("un") > 0).alias("k")).first()
    total, good = g["total"] or 0.0, g["good"] or 0.0
    mean = good / total if total else 1.0
    us = u.agg(F.sum(F.coalesce(F.col("un") * F.pow(F.try_divide(F.col("us"), F.col("un")) - F.lit(mean), 2), F.lit(0.0))).alias("us_")).first()
    row = {
        "total": total, "good": good, "hs": hd["hs"], "hn": total, "hq": du["hq"], "hk": du["hk"], "ds": du["ds_"], "dq": g["dq"], "dk": g["dk"],
        "us": us["us_"], "uq": g["sq"] / total if total else 0.0, "uk": max(0, (g["k"] or 0) - 1),
    }
    ku = _strength(row, "us", "total", "uq", "uk", PLAIN_STRENGTH)
    kd = _strength(row, "ds", "total", "dq", "dk", ku)
    kh = _strength(row, "hs", "total", "hq", "hk", kd)

    # Each level's prior leaves out the member it is for.
    all_ = h.join(d.select("domain", "dn", "ds"), "domain", "left").join(u.select("suffix", "un", "us"), "suffix", "left")
    m0 = F.lit(mean)
    m1 = (F.col("us") - F.col("ds") + F.lit(ku) * m0) / (F.col("un") - F.col("dn") + F.lit(ku))
    m2 = (F.col("ds") - F.col("s") + F.lit(kd) * F.col("m1")) / (F.col("dn") - F.col("n") + F.lit(kd))
    out = all_.withColumn("m1", m1).withColumn("m2", m2)
    a, b = F.col("s") + F.lit(kh) * F.col("m2"), F.col("n") - F.col("s") + F.lit(kh) * (1 - F.col("m2"))
    out = out.withColumns({"_a": a, "_b": b}).withColumn("reputation", F.col("_a") / (F.col("_a") + F.col("_b")))
    return out.select("host", "domain", "suffix", F.col("n").cast("long").alias("host_labelled"), F.col("s").cast("long").alias("host_good"), "reputation", beta_quantile(F.col("_a"), F.col("_b"), level).alias("upper_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, floor: float = 0.5, level: float = 0.95, suffixes=LONG_SUFFIXES) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with host, path, rule, verdict and the host's posterior.

    ``outcomes``: page urls with a column ``good``.
    """
    ruled = with_host(pages.select("page_id", "url"))
    rule, verdict = rule_of(rules)
    ruled = ruled.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_ruled"))
    known = host_reputation(with_host(outcomes.select("url", "good")).select("host", "good"), ruled.select("host").distinct(), level, suffixes)
    # Written: one posterior a host, not one a page.
    out = ruled.join(materialise(known, "posteriors"), "host", "left")
    own = F.when(F.col("upper_bound") < floor, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", own).alias("verdict"), "host_labelled", "host_good", "reputation", "upper_bound")

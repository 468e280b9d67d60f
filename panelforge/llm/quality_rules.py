"""Quality rules: rule statistics of each text and robust multivariate outliers.

DataFrame functions only.  Every document gets a vector of transformed statistics;
per (lang, source) a minimum-covariance-determinant estimate of its centre and
scatter is found by concentration steps from the four starts of ``_starts``: keep the
``h`` share of rows with the smallest Mahalanobis distance, recompute mean and
covariance from them, repeat until the determinant falls no more.  The estimate of the
smallest determinant is the core.  ``steps`` more steps widen it for precision to the
``most`` share of rows, or to those near it (REWEIGHT) where these are fewer, so junk of
more than a quarter of a group stays out.  Rows are rejected by their distance under the
last estimate, scaled so that its median is that of a chi-square variable.
Determinants are those of the covariance with the floors of VECTOR added, which
concentration steps lower too.

All reductions (quantile sketches, sums of products) merge partial results, so a
group with a third of all rows is no task of its own.  The group table has one row a
(lang, source); Spark joins it by its real size.

Defined results: null text has no words, fails the base rule and is not kept.  Null
lang or source is a group of its own.  Groups of fewer than ``min_group`` usable rows
are pooled by language, those of small languages over all languages; while even that
has fewer rows, nothing is an outlier.  Repeated rows, also of one id, are judged one by
one.  Among starts of equal determinant the first counts; rows at the cut distance are
inside.  A very long text is one row's work like any other.  Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_GAP = "[ \\t\\n\\x0B\\f\\r]+"
_SYMBOLS = "#*$%&|<>"
#: Statistic vector: name and floor of its standard deviation.  The floors keep a
#: statistic that is constant over a group's core from rejecting whatever differs.
VECTOR = {"log_words": 0.5, "log_word_length": 0.15, "symbol_share": 0.06, "repeat_share": 0.12, "dup_lines": 0.5}
CHI2_MEDIAN = 4.351  # of a chi-square variable with as many degrees as VECTOR
CHI2_CUT = 30.86  # its quantile at 0.99999
REWEIGHT = 12.83  # its quantile at 0.975
FALL = 1e-3  # of a log determinant; less than that is the error of the quantile sketches


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of BASE and n_lines; exact, one pass, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_t", t).withColumn("_w", F.array_remove(F.split(F.col("_t"), _GAP), ""))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    n = F.size("_w")
    five = lambda i: [F.get(F.col("_w"), i + k) for k in range(5)]  # noqa: E731  slice() would copy the whole array each time
    df = df.withColumn("_l", lines).withColumn(
        "_h", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*five(i)))).otherwise(F.array().cast("array<bigint>"))
    )
    # Equal windows have equal hashes: only a text with an equal pair of hashes needs its windows compared.
    window = lambda i: F.struct(F.concat_ws(" ", *five(i)).alias("g"), i.alias("i"))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform(F.sequence(F.lit(0), n - 5), window))))
    same = lambda x, i: (x["g"] == F.try_element_at(F.col("_s"), i + 2)["g"]) | ((i > 0) & (x["g"] == F.try_element_at(F.col("_s"), F.greatest(i, F.lit(1)))["g"]))
    df = df.withColumn("_p", F.array_sort(F.transform(F.filter(F.col("_s"), lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(F.col("_p"), lambda x, i: F.least(F.lit(5), F.coalesce(F.try_element_at(F.col("_p"), i + 2) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x
    )
    return df.select(
        *[F.col(c) for c in docs.columns if c not in BASE and c != "n_lines"],
        n.cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    made = [F.log(words), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_repeat_words") / words), F.log1p(F.col("n_dup_lines").cast("double"))]
    return [c.alias(name) for c, name in zip(made, VECTOR, strict=True)]


def _distance() -> Column:
    """Squared Mahalanobis distance to the centre _M by forward substitution with the Cholesky factor _L.

    One SQL text: built from columns, a step's expressions are thousands of calls to the JVM.
    """
    z: list[str] = []
    for i, name in enumerate(VECTOR):
        rest = "".join(f" - l{i}{k} * {z[k]}" for k in range(i))
        z.append(f"(({name} - m{i}{rest}) / l{i}{i})")
    return F.expr(" + ".join(f"{x} * {x}" for x in z))


_P = len(VECTOR)
_M = [f"m{i}" for i in range(_P)]
_L = [[f"l{i}{k}" for k in range(i + 1)] for i in range(_P)]
_FLAT = [x for r in _L for x in r]
_KEYS = ["_lang", "_source"]
_ESTIMATE = [*_KEYS, "_start", "n", "_det", *_M, *_FLAT]


def _cholesky(groups: DataFrame) -> DataFrame:
    """Columns l<i><k> from the covariances c<i><k>, one column of the factor after another."""
    for k in range(_P):
        rest = [f"(c{i}{k}" + "".join(f" - l{i}{j} * l{k}{j}" for j in range(k)) + ")" for i in range(k, _P)]
        root = f"sqrt(greatest({rest[0]}, 1e-6D))"
        groups = groups.selectExpr("*", f"{root} AS l{k}{k}", *[f"{rest[i - k]} / {root} AS l{i}{k}" for i in range(k + 1, _P)])
    return groups


def _starts(rows: DataFrame) -> DataFrame:
    """Four estimates a group: medians and quartile scales, shortest halves, lower and upper quartiles with the scale of their side.

    Whatever stands on one side of the rest, one start stays clear of it up to half the rows.
    """
    grid = [k / 20 for k in range(21)]
    quantiles = [F.percentile_approx(name, F.array(*[F.lit(x) for x in grid]), 1000).alias(f"q{i}") for i, name in enumerate(VECTOR)]
    groups = materialise(rows.groupBy(*_KEYS).agg(F.count("*").alias("n"), *quantiles), "mcd-quantiles")
    made = []
    for start in range(4):
        cols = []
        for i, floor in enumerate(VECTOR.values()):
            q = lambda k: F.col(f"q{i}")[k]  # noqa: B023, E731
            if start == 1:
                halves = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.struct((q(k + 10) - q(k)).alias("width"), ((q(k + 10) + q(k)) / 2).alias("centre"))))  # noqa: B023
                centre, width = halves["centre"], halves["width"]
            else:
                k, low, high, sides = {0: (10, 5, 15, 1), 2: (5, 5, 10, 2), 3: (15, 10, 15, 2)}[start]
                centre, width = q(k), sides * (q(high) - q(low))
            scale = width / F.lit(1.349)
            cols += [centre.alias(f"m{i}"), *[(scale * scale + F.lit(floor * floor) if i == k else F.lit(0.0)).alias(f"c{i}{k}") for k in range(i + 1)]]
        made.append(groups.select(*_KEYS, F.lit(start).alias("_start"), "n", F.lit(float("inf")).alias("_det"), *cols))
    every = made[0]
    for x in made[1:]:
        every = every.unionByName(x)
    return _cholesky(every).select(*_ESTIMATE)


def _fit(rows: DataFrame, groups: DataFrame, limit: str) -> DataFrame:
    """The estimates of the rows at most ``limit`` from ``groups``; _before is the log determinant of those."""
    floors, lower = list(VECTOR.values()), [(i, k) for i in range(_P) for k in range(i + 1)]
    inside = rows.join(groups, _KEYS).withColumn("_d", _distance()).where(F.col("_d") <= F.col(limit))
    centred = [f"({name} - m{i})" for i, name in enumerate(VECTOR)]  # about the last centre: no cancellation
    sums = [f"avg({centred[i]}) AS a{i}" for i in range(_P)] + [f"avg({centred[i]} * {centred[k]}) AS b{i}{k}" for i, k in lower]
    kept = ["max(n) AS n", "max(_det) AS _before", *[f"max({m}) AS {m}" for m in _M]]
    made = inside.groupBy(*_KEYS, "_start").agg(*[F.expr(x) for x in kept + sums])
    cov = [f"b{i}{k} - a{i} * a{k} + {floors[i] ** 2 if i == k else 0.0!r}D AS c{i}{k}" for i, k in lower]
    made = made.selectExpr(*_KEYS, "_start", "n", "_before", *[f"m{i} + a{i} AS m{i}" for i in range(_P)], *cov)
    det = " + ".join(f"2 * ln(l{i}{i})" for i in range(_P))
    return materialise(_cholesky(made).withColumn("_det", F.expr(det)).select(*_ESTIMATE, "_before"), "mcd-step")


def _step(rows: DataFrame, groups: DataFrame, h: float) -> DataFrame:
    cuts = rows.join(groups, _KEYS).withColumn("_d", _distance()).groupBy(*_KEYS, "_start").agg(F.percentile_approx("_d", h, 1000).alias("_cut"))
    # Written, the cuts are a table of known size, so rows meet them where they are read.
    return _fit(rows, materialise(cuts.join(groups, [*_KEYS, "_start"]), "mcd-cut"), "_cut")


def _least_determinant(rows: DataFrame, h: float) -> DataFrame:
    """One estimate a group: the smallest determinant that steps from any start come to."""
    active, found = materialise(_starts(rows), "mcd-start"), None
    while True:
        made = _step(rows, active, h)
        found = made if found is None else found.unionByName(made)
        active = made.where(F.col("_det") < F.col("_before") - FALL).drop("_before")
        if active.isEmpty():
            break
    best = found.groupBy(*_KEYS).agg(F.min_by(F.struct("_start", "n", "_det", *_M, *_FLAT), F.struct("_det", "_start")).alias("x"))
    return materialise(best.select(*_KEYS, "x.*"), "mcd-best")


def _scaled(rows: DataFrame, groups: DataFrame, most: float) -> DataFrame:
    """``groups`` with _scale; the floors make the scatter wider than the core's: distances are scaled down, never up."""
    quantiles = F.percentile_approx("_d", F.array(F.lit(0.5), F.lit(most)), 1000).alias("_q")
    found = rows.join(groups, _KEYS).withColumn("_d", _distance()).groupBy(*_KEYS).agg(quantiles).join(groups, _KEYS)
    scale = F.greatest(F.col("_q")[0] / F.lit(CHI2_MEDIAN), F.lit(1.0))
    return materialise(found.select(*_ESTIMATE, scale.alias("_scale"), F.least(F.col("_q")[1], F.lit(REWEIGHT) * scale).alias("_near")), "mcd-scale")


def robust_outliers(stats: DataFrame, steps: int = 3, h: float = 0.55, most: float = 0.75, min_group: int = 50, cut: float = CHI2_CUT) -> DataFrame:
    """``stats`` (with BASE, lang, source and usable boolean) with distance and outlier.

    ``distance`` is null where the row is not usable or no group is large enough.
    """
    rows = stats.select("*", *_vector(), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("_lang0"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source0"))
    # Which level has enough rows: one count table, three levels.
    counts = rows.where("usable").groupBy("_lang0", "_source0").agg(F.count("*").alias("n1"))
    small = counts.where(F.col("n1") < min_group).groupBy("_lang0").agg(F.sum("n1").alias("n2"))
    level = (
        counts.join(small, "_lang0", "left")
        .select(
            "_lang0", "_source0",
            F.when(F.col("n1") >= min_group, F.col("_lang0")).when(F.col("n2") >= min_group, F.col("_lang0")).otherwise(F.lit("*")).alias("_lang"),
            F.when(F.col("n1") >= min_group, F.col("_source0")).otherwise(F.lit("*")).alias("_source"),
        )
    )
    rows = materialise(rows.join(level, ["_lang0", "_source0"], "left"), "mcd-rows")
    use = rows.where("usable").select(*_KEYS, *VECTOR)
    groups = _scaled(use, _least_determinant(use, h), most)
    for _ in range(steps):
        groups = _scaled(use, _fit(use, groups, "_near").drop("_before"), most)
    groups = groups.where(F.col("n") >= min_group).select(*_KEYS, *_M, *_FLAT, "_scale")
    out = rows.join(groups, _KEYS, "left").withColumn("distance", F.when(F.col("usable"), _distance() / F.col("_scale")))
    return out.select(*stats.columns, "distance", F.coalesce(F.col("distance") > cut, F.lit(False)).alias("outlier"))


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """doc_id, BASE, base_failed, kept, distance for every row of ``docs``."""
    stats = base_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text").withColumn("base_failed", base_failed())
    # Read back, no filter is pushed below the array work, which would redo it per element.
    stats = materialise(stats, "rule-statistics")
    judged = robust_outliers(stats.withColumn("usable", ~F.col("base_failed")), **options)
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & ~F.col("outlier")).alias("kept"), "distance")

"""The functions of the expression language as Column builders.

A builder gets the panel's axes, its column arguments and its literal arguments.  Kinds:
``scalar`` (no window), ``series`` (rows of a symbol), ``cross`` (rows of a time), and
``steps``: a list of builders, each of the columns before it, for windows over windows;
the last one has none.
``register`` adds a function of your own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .windows import Axes, both, div, num, pearson


@dataclass(frozen=True)
class Function:
    name: str
    kind: str
    build: Callable[..., Column]
    columns: tuple[int, int]  # how many column arguments, at least and at most


REGISTRY: dict[str, list[Function]] = {}


def register(name: str, kind: str, columns: tuple[int, int] | int = 1):
    span = (columns, columns) if isinstance(columns, int) else columns

    def add(build):
        REGISTRY.setdefault(name, []).append(Function(name, kind, build, span))
        return build

    return add


def _int(p, least: int = 1) -> int:
    if p != int(p) or p < least:
        raise ValueError(f"a whole number of at least {least} is asked for, not {p}")
    return int(p)


def _flag(c: Column) -> Column:
    """Numbers and comparisons as conditions; missing is false."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def _all_present(*cs: Column) -> Column:
    ok = cs[0].isNotNull()
    for c in cs[1:]:
        ok = ok & c.isNotNull()
    return ok


# -- element by element ----------------------------------------------------------

_SCALAR = {
    "ABS": F.abs, "NEG": lambda x: -x, "SIGN": F.signum, "EXP": F.exp, "LOG": lambda x: F.log1p(F.when(x > -1, x)), "SQRT": lambda x: F.sqrt(F.when(x >= 0, x)),
    "INV": lambda x: div(F.lit(1.0), x), "FLOOR": lambda x: F.floor(x).cast("double"),
}
for _name, _f in _SCALAR.items():
    register(_name, "scalar")(lambda ax, x, f=_f: num(f(x.cast("double"))))
register("POW", "scalar")(lambda ax, x, n: num(F.pow(x.cast("double"), F.lit(float(n)))))
register("POW", "scalar", 2)(lambda ax, x, n: num(F.pow(x.cast("double"), n.cast("double"))))

_OPS = {"ADD": lambda a, b: a + b, "SUBTRACT": lambda a, b: a - b, "MULTIPLY": lambda a, b: a * b, "DIVIDE": div}
for _name, _f in _OPS.items():
    register(_name, "scalar", 2)(lambda ax, a, b, f=_f: f(a.cast("double"), b.cast("double")))

_COMPARE = {
    "GT": lambda a, b: F.coalesce(a > b, F.lit(False)), "LT": lambda a, b: F.coalesce(a < b, F.lit(False)), "GE": lambda a, b: F.coalesce(a >= b, F.lit(False)),
    "LE": lambda a, b: F.coalesce(a <= b, F.lit(False)), "EQ": lambda a, b: F.coalesce(a == b, F.lit(False)), "NE": lambda a, b: F.coalesce(a != b, F.lit(True)),
}
for _name, _f in _COMPARE.items():
    register(_name, "scalar", 2)(lambda ax, a, b, f=_f: f(a, b))
register("AND", "scalar", 2)(lambda ax, a, b: _flag(a) & _flag(b))
register("OR", "scalar", 2)(lambda ax, a, b: _flag(a) | _flag(b))


@register("WHERE", "scalar", 3)
def _where(ax, c, a, b):
    return F.when(_flag(c), a.cast("double")).otherwise(b.cast("double"))


@register("FILTER", "scalar", 2)
def _filter(ax, x, c):
    return F.when(x.isNull(), None).when(_flag(c), x.cast("double")).otherwise(F.lit(0.0))


@register("MAX", "scalar", (2, 3))
def _max(ax, *xs):
    return F.when(_all_present(*xs), F.greatest(*[x.cast("double") for x in xs]))


@register("MIN", "scalar", (2, 3))
def _min(ax, *xs):
    return F.when(_all_present(*xs), F.least(*[x.cast("double") for x in xs]))


# -- series of a symbol ------------------------------------------------------------

register("DELTA", "series")(lambda ax, x, p=1: x - F.lag(x, _int(p, 0)).over(ax.ordered()))
register("DELAY", "series")(lambda ax, x, p=1: F.lag(x, _int(p, 0)).over(ax.ordered()))
register("TS_MEAN", "series")(lambda ax, x, p=5: F.avg(x).over(ax.series(_int(p))))
register("TS_SUM", "series")(lambda ax, x, p=5: F.sum(x).over(ax.series(_int(p))))
register("SUMAC", "series")(lambda ax, x, p=10: F.sum(x).over(ax.series(_int(p))))
register("TS_MAX", "series")(lambda ax, x, p=5: F.max(x).over(ax.series(_int(p))))
register("TS_MIN", "series")(lambda ax, x, p=5: F.min(x).over(ax.series(_int(p))))
register("TS_MEDIAN", "series")(lambda ax, x, p=5: F.percentile(x, F.lit(0.5)).over(ax.series(_int(p))))
register("TS_STD", "series")(lambda ax, x, p=20: F.stddev_samp(x).over(ax.series(_int(p))))
register("COUNT", "series")(lambda ax, c, p=20: F.sum(_flag(c).cast("double")).over(ax.series(_int(p))))
register("SUMIF", "series", 2)(lambda ax, x, c, p=20: F.sum(x * _flag(c).cast("double")).over(ax.series(_int(p))))


@register("TS_QUANTILE", "series")
def _ts_quantile(ax, x, p=5, q=0.5):
    if 0 < p < 1 <= q:
        p, q = q, p
    if not 0 <= q <= 1:
        raise ValueError(f"no quantile: {q}")
    return F.percentile(x, F.lit(float(q))).over(ax.series(_int(p)))


@register("PERCENTILE", "series")
def _percentile(ax, x, q, p=None):
    """Without a period: of the symbol's whole session, which reads rows to come."""
    return F.percentile(x, F.lit(float(q))).over(ax.whole_series() if p is None else ax.series(_int(p)))


@register("TS_VAR", "series")
def _ts_var(ax, x, p=5, ddof=1):
    w = ax.series(_int(p))
    n = F.count(x).over(w)
    return F.when(n > ddof, F.var_pop(x).over(w) * n / (n - F.lit(int(ddof))))


@register("TS_ZSCORE", "series")
def _ts_zscore(ax, x, p=5):
    w = ax.series(_int(p))
    return div(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def _moments(x: Column, w, power: int, least: int) -> Column:
    f = F.skewness if power == 3 else F.kurtosis
    varies = F.stddev_samp(x).over(w) > 1e-12 * F.sqrt(F.avg(x * x).over(w))
    return F.when((F.count(x).over(w) >= least) & varies, num(f(x).over(w)))


register("TS_SKEW", "series")(lambda ax, x, p=5: _moments(x, ax.series(_int(p)), 3, 3))
register("TS_KURT", "series")(lambda ax, x, p=5: _moments(x, ax.series(_int(p)), 4, 4))


def _frame(ax: Axes, x: Column, p: int | None) -> Column:
    """The frame's values, oldest first, missing ones kept as NULL."""
    return F.transform(F.collect_list(F.struct(x.cast("double").alias("v"))).over(ax.series(p)), lambda s: s["v"])


def _complete(a: Column) -> Column:
    return ~F.exists(a, lambda v: v.isNull())


@register("TS_RANK", "series")
def _ts_rank(ax, x, p=5):
    a = F.collect_list(x.cast("double")).over(ax.series(_int(p)))
    below, equal = F.size(F.filter(a, lambda v: v < x)), F.size(F.filter(a, lambda v: v == x))
    return F.when(x.isNotNull(), div(below + (equal + 1) / F.lit(2.0), F.size(a)))


def _since(ax, x, p, pick) -> Column:
    a = _frame(ax, x, _int(p))
    return F.when(_complete(a), (F.size(a) - F.array_position(a, pick(a))).cast("double"))


register("TS_ARGMAX", "series")(lambda ax, x, p=5: _since(ax, x, p, F.array_max))
register("TS_ARGMIN", "series")(lambda ax, x, p=5: _since(ax, x, p, F.array_min))
register("HIGHDAY", "series")(lambda ax, x, p=5: _since(ax, x, p, F.array_max) + 1)
register("LOWDAY", "series")(lambda ax, x, p=5: _since(ax, x, p, F.array_min) + 1)


def _middle(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


@register("TS_MAD", "series")
def _ts_mad(ax, x, p=5):
    a = _frame(ax, x, _int(p))
    return F.when(_complete(a), _middle(F.transform(a, lambda v: F.abs(v - _middle(a)))))


@register("TS_CORR", "series", 2)
def _ts_corr(ax, x, y, p=5):
    return pearson(x, y, ax.series(_int(p)))


def corr_with(ax: Axes, x: Column, weights: list[float]) -> Column:
    """Correlation of the last rows with fixed weights, the newest row with the last one; 0 where the rows don't vary."""
    n, a = len(weights), F.collect_list(F.struct(x.cast("double").alias("v"))).over(ax.series(len(weights)))
    w = F.array(*[F.lit(float(v)) for v in weights])
    pairs = F.filter(F.transform(a, lambda s, i: F.struct(s["v"].alias("v"), F.get(w, i + n - F.size(a)).alias("w"))), lambda s: s["v"].isNotNull())
    total = lambda f: F.aggregate(F.transform(pairs, f), F.lit(0.0), lambda t, v: t + v)
    k = F.size(pairs)
    mv, mw = total(lambda s: s["v"]) / k, total(lambda s: s["w"]) / k
    cov, vv, ww = total(lambda s: (s["v"] - mv) * (s["w"] - mw)), total(lambda s: (s["v"] - mv) * (s["v"] - mv)), total(lambda s: (s["w"] - mw) * (s["w"] - mw))
    return F.when(k >= 2, F.coalesce(F.try_divide(cov, F.sqrt(vv * ww)), F.lit(0.0)))


@register("TS_COVARIANCE", "series", 2)
def _ts_cov(ax, x, y, p=5):
    return F.covar_samp(*both(x, y)).over(ax.series(_int(p)))


@register("TS_PCTCHANGE", "series")
def _pct(ax, x, p=1):
    return F.coalesce(div(x, F.lag(x, _int(p, 0)).over(ax.ordered())) - 1, F.lit(0.0))


def _ewm(ax, x, alpha: float) -> list[Callable[..., Column]]:
    """Weights (1-alpha)^age by row, over the values that are present, in linear time.

    Running sums of x * (1-alpha)^-row stay exact as long as the powers stay in range, so
    rows are taken in chunks of that many, and a chunk goes on from the last one that has
    values: what lies before that weighs less than 1e-200.
    """
    keep = 1.0 - alpha
    rows = max(1, int(200 * math.log(10) / -math.log(keep))) if 0 < keep < 1 else 1
    k = F.lit(keep)
    place = lambda r: (r - 1) % rows
    power = lambda e: F.pow(k, e.cast("double"))

    def number():
        return F.row_number().over(ax.ordered())

    def sums(r):
        w = Window.partitionBy(*([ax.session] if ax.session else []), ax.symbol, F.floor((r - 1) / rows)).orderBy(ax.time).rowsBetween(Window.unboundedPreceding, 0)
        x_ = x.cast("double")
        return F.struct(F.sum(x_ * power(-place(r))).over(w).alias("top"), F.sum(F.when(x_.isNotNull(), power(-place(r)))).over(w).alias("all"))

    def carried(r, s):
        end = F.when((place(r) == rows - 1) & s["all"].isNotNull(), F.struct(r.alias("r"), (s["top"] * power(place(r))).alias("top"), (s["all"] * power(place(r))).alias("all")))
        return F.last(end, ignorenulls=True).over(ax.series(None).rowsBetween(Window.unboundedPreceding, -1))

    def value(r, s, c):
        part = lambda n: F.coalesce(s[n] * power(place(r)), F.lit(0.0)) + F.coalesce(c[n] * power(r - c["r"]), F.lit(0.0))
        return div(part("top"), part("all"))

    return [number, sums, carried, value]


register("EMA", "steps")(lambda ax, x, p: _ewm(ax, x, 2.0 / (p + 1)))


@register("SMA", "steps")
def _sma(ax, x, m, n=None):
    return [lambda: F.avg(x).over(ax.series(_int(m))), lambda v: v] if n is None else _ewm(ax, x, n / m)


def _weighted(a: Column, weight, total) -> Column:
    s = F.aggregate(F.transform(a, lambda v, i: v * weight(i, F.size(a))), F.lit(0.0), lambda t, v: t + v)
    return F.when(_complete(a), s / total(F.size(a)))


@register("WMA", "series")
def _wma(ax, x, p=20):
    # 0.9 to the age of a row, over the frame's own total
    return _weighted(_frame(ax, x, _int(p)), lambda i, n: F.pow(F.lit(0.9), (n - 1 - i).cast("double")), lambda n: (1 - F.pow(F.lit(0.9), n.cast("double"))) / F.lit(0.1))


@register("DECAYLINEAR", "series")
def _decay(ax, x, p=5):
    # 1..p from the oldest row; a shorter frame uses the first weights, over the full total
    return _weighted(_frame(ax, x, _int(p)), lambda i, n: (i + 1).cast("double"), lambda n: F.lit(_int(p) * (_int(p) + 1) / 2.0))


@register("PROD", "series")
def _prod(ax, x, p=5):
    if p != int(p):
        return x * F.lit(float(p))
    a = _frame(ax, x, _int(p))
    return F.when(_complete(a), F.aggregate(a, F.lit(1.0), lambda t, v: t * v))


# -- cross-sections of a time --------------------------------------------------------


@register("RANK", "cross")
def _rank(ax, x):
    c = ax.cross()
    ties = Window.partitionBy(*([ax.session] if ax.session else []), ax.time, x)
    rank = F.rank().over(c.orderBy(x.asc_nulls_last())) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return F.when(x.isNotNull(), div(rank, F.count(x).over(c)))


register("MEAN", "cross")(lambda ax, x: F.avg(x).over(ax.cross()))
register("STD", "cross")(lambda ax, x: F.stddev_samp(x).over(ax.cross()))
register("MEDIAN", "cross")(lambda ax, x: F.percentile(x, F.lit(0.5)).over(ax.cross()))
register("MAX", "cross")(lambda ax, x: F.max(x).over(ax.cross()))
register("MIN", "cross")(lambda ax, x: F.min(x).over(ax.cross()))
register("SKEW", "cross")(lambda ax, x: _moments(x, ax.cross(), 3, 3))
register("KURT", "cross")(lambda ax, x: _moments(x, ax.cross(), 4, 4))
register("ZSCORE", "cross")(lambda ax, x: div(x - F.avg(x).over(ax.cross()), F.stddev_samp(x).over(ax.cross())))
register("SCALE", "cross")(lambda ax, x, target=1.0: x * div(F.lit(float(target)), F.sum(F.abs(x)).over(ax.cross())))

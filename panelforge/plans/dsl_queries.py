"""Queries of the expression language over supplier months, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import PANEL, exact_rounds, rank_pct, rounded
from ..sources.panel import MONTHS, supplier_months
from .compiler import evaluate


def _w(k: int) -> str:
    return f"OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


_S, _C, _O = "OVER (PARTITION BY sym)", "OVER (PARTITION BY dt)", "OVER (PARTITION BY sym ORDER BY dt)"


def _corr(x: str, y: str, over: str) -> str:
    m = lambda z: f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {z} END"
    sx, sy = f"stddev_samp({m(x)}) {over}", f"stddev_samp({m(y)}) {over}"
    return f"CASE WHEN {sx} > 1e-12 AND {sy} > 1e-12 THEN covar_samp({m(x)}, {m(y)}) {over} / ({sx} * {sy}) END"


def _skew(x: str, over: str) -> str:
    n, m1, m2, m3 = f"count({x}) {over}", f"avg({x}) {over}", f"avg({x}*{x}) {over}", f"avg({x}*{x}*{x}) {over}"
    return f"CASE WHEN {n} >= 3 AND stddev_samp({x}) {over} > 1e-12 THEN ({m3} - 3*({m1})*({m2}) + 2*({m1})*({m1})*({m1})) / pow(({m2}) - ({m1})*({m1}), 1.5) END"


def _kurt(x: str, over: str) -> str:
    n = f"count({x}) {over}"
    return f"CASE WHEN {n} >= 4 AND stddev_samp({x}) {over} > 1e-12 THEN kurtosis_pop({x}) {over} END"


#: Frames as rows: r has the row's own columns, age counts back, y is the framed value.
_FRAME = """q AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY dt) AS rn FROM p),
f AS (SELECT r.dt, r.sym, r.x AS own, b.x AS y, b.rn AS pos, r.rn - b.rn AS age, r.rn AS rn FROM q r JOIN q b ON r.sym = b.sym AND b.rn <= r.rn)"""

Q: dict[str, tuple[dict[str, tuple[str, int | None]], dict[str, str]]] = {
    "dsl_arith": ({"v": ("$price + $qty * 2 - $vol / $qty", 4), "z": ("$qty / ($qty - $qty)", 4), "m": ("$x - $price", 4)}, {"v": "price + qty*2 - vol/nullif(qty,0)", "z": "NULL::DOUBLE", "m": "x - price"}),
    "dsl_abs_neg_sign": ({"a": ("ABS($qty - 25)", 6), "b": ("NEG($qty)", 6), "c": ("SIGN($qty - 25)", 0), "d": ("-$x", 6)}, {"a": "abs(qty-25)", "b": "-qty", "c": "sign(qty-25)::DOUBLE", "d": "-x"}),
    "dsl_exp_log_sqrt": ({"a": ("EXP($qty / 10)", 6), "b": ("LOG($vol)", 6), "c": ("SQRT($qty - 25)", 6), "d": ("LOG($qty - 30)", 6)}, {"a": "exp(qty/10)", "b": "ln(1+vol)", "c": "CASE WHEN qty >= 25 THEN sqrt(qty-25) END", "d": "CASE WHEN qty > 29 THEN ln(qty-29) END"}),
    "dsl_inv_pow_floor": ({"a": ("INV($qty - 25)", 4), "b": ("POW($qty, 2)", 4), "c": ("FLOOR($qty)", 0), "d": ("POW($qty - 25, 0.5)", 6)}, {"a": "1/nullif(qty-25,0)", "b": "pow(qty,2)", "c": "floor(qty)::DOUBLE", "d": "CASE WHEN qty >= 25 THEN pow(qty-25,0.5) END"}),
    "dsl_max_min_elem": ({"a": ("MAX($qty, $x)", 6), "b": ("MIN($qty, 25, $vol)", 6)}, {"a": "CASE WHEN x IS NOT NULL THEN greatest(qty,x) END", "b": "least(qty,25,vol)"}),
    "dsl_compare": ({"a": ("$x > 36000", None), "b": ("$x <= $price", None), "c": ("$x == $price", None), "d": ("$x != $price", None), "e": ("5 < $qty", None), "f": ("GE($x, 36000)", None)}, {"a": "coalesce(x>36000,false)", "b": "coalesce(x<=price,false)", "c": "coalesce(x=price,false)", "d": "coalesce(x<>price,true)", "e": "5<qty", "f": "coalesce(x>=36000,false)"}),
    "dsl_logic_where": ({"a": ("WHERE(($qty > 25) && ($x > 36000), $qty, $vol)", 6), "b": ("($qty > 25 || $x > 36000) ? $qty : -1", 6), "c": ("AND($qty > 25, $vol > 100)", None), "d": ("OR($qty > 25, $vol > 100)", None)}, {"a": "CASE WHEN qty>25 AND x>36000 THEN qty ELSE vol END", "b": "CASE WHEN qty>25 OR x>36000 THEN qty ELSE -1 END", "c": "qty>25 AND vol>100", "d": "qty>25 OR vol>100"}),
    "dsl_filter": ({"a": ("FILTER($x, $qty > 25)", 6)}, {"a": "CASE WHEN x IS NULL THEN NULL WHEN qty>25 THEN x ELSE 0 END"}),
    "ts_delta": ({"a": ("DELTA($x, 1)", 4), "b": ("DELTA($qty, 3)", 4)}, {"a": f"x - lag(x,1) {_O}", "b": f"qty - lag(qty,3) {_O}"}),
    "ts_delay": ({"a": ("DELAY($x)", 6), "b": ("DELAY($qty, 4)", 6)}, {"a": f"lag(x,1) {_O}", "b": f"lag(qty,4) {_O}"}),
    "ts_mean": ({"a": ("TS_MEAN($x)", 3), "b": ("TS_MEAN($qty, 3)", 5)}, {"a": f"avg(x) {_w(5)}", "b": f"avg(qty) {_w(3)}"}),
    "ts_sum": ({"a": ("TS_SUM($x, 5)", 3)}, {"a": f"sum(x) {_w(5)}"}),
    "sumac": ({"a": ("SUMAC($x)", 3)}, {"a": f"sum(x) {_w(10)}"}),
    "ts_max_min": ({"a": ("TS_MAX($x, 5)", 6), "b": ("TS_MIN($x, 4)", 6)}, {"a": f"max(x) {_w(5)}", "b": f"min(x) {_w(4)}"}),
    "ts_median": ({"a": ("TS_MEDIAN($x, 5)", 4)}, {"a": f"median(x) {_w(5)}"}),
    "ts_quantile": ({"a": ("TS_QUANTILE($x, 8, 0.25)", 3), "b": ("TS_QUANTILE($qty, 0.9, 6)", 5)}, {"a": f"quantile_cont(x,0.25) {_w(8)}", "b": f"quantile_cont(qty,0.9) {_w(6)}"}),
    "percentile_full": ({"a": ("PERCENTILE($x, 0.5)", 3), "b": ("PERCENTILE($x, 0.8, 6)", 3)}, {"a": f"quantile_cont(x,0.5) {_S}", "b": f"quantile_cont(x,0.8) {_w(6)}"}),
    "ts_std_var": ({"a": ("TS_STD($qty)", 5), "b": ("TS_VAR($qty, 5)", 4), "c": ("TS_VAR($qty, 5, 0)", 4)}, {"a": f"stddev_samp(qty) {_w(20)}", "b": f"var_samp(qty) {_w(5)}", "c": f"var_pop(qty) {_w(5)}"}),
    "ts_zscore": ({"a": ("TS_ZSCORE($qty, 5)", 5)}, {"a": f"(qty - avg(qty) {_w(5)}) / nullif(stddev_samp(qty) {_w(5)}, 0)"}),
    "ts_skew_kurt": ({"a": ("TS_SKEW($qty, 8)", 3), "b": ("TS_KURT($qty, 8)", 3)}, {"a": _skew("qty", _w(8)), "b": _kurt("qty", _w(8))}),
    "ts_corr": ({"a": ("TS_CORR($x, $qty, 8)", 4)}, {"a": _corr("x", "qty", _w(8))}),
    "ts_cov": ({"a": ("TS_COVARIANCE($x, $qty, 8)", 2)}, {"a": f"covar_samp(CASE WHEN qty IS NOT NULL THEN x END, CASE WHEN x IS NOT NULL THEN qty END) {_w(8)}"}),
    "ts_pctchange": ({"a": ("TS_PCTCHANGE($x)", 6), "b": ("TS_PCTCHANGE($qty, 2)", 6)}, {"a": f"coalesce(x/nullif(lag(x,1) {_O},0) - 1, 0)", "b": f"coalesce(qty/nullif(lag(qty,2) {_O},0) - 1, 0)"}),
    "prod": ({"a": ("PROD($qty, 3)", 2)}, {"a": f"CASE WHEN count(qty) {_w(3)} = count(*) {_w(3)} THEN product(qty) {_w(3)} END"}),
    "count_cond": ({"a": ("COUNT($qty > 25, 6)", 0)}, {"a": f"sum(CASE WHEN qty>25 THEN 1.0 ELSE 0 END) {_w(6)}"}),
    "sumif": ({"a": ("SUMIF($x, 6, $qty > 25)", 3)}, {"a": f"sum(x * CASE WHEN qty>25 THEN 1.0 ELSE 0 END) {_w(6)}"}),
    "xs_rank": ({"a": ("RANK($x)", 8), "b": ("RANK(FLOOR($qty))", 8)}, {"a": rank_pct("x"), "b": rank_pct("floor(qty)")}),
    "xs_mean_std_median": ({"a": ("MEAN($x)", 3), "b": ("STD($qty)", 5), "c": ("MEDIAN($x)", 3)}, {"a": f"avg(x) {_C}", "b": f"stddev_samp(qty) {_C}", "c": f"median(x) {_C}"}),
    "xs_max_min": ({"a": ("MAX($x)", 6), "b": ("MIN($x)", 6)}, {"a": f"max(x) {_C}", "b": f"min(x) {_C}"}),
    "xs_skew_kurt": ({"a": ("SKEW($qty)", 3), "b": ("KURT($qty)", 3)}, {"a": _skew("qty", _C), "b": _kurt("qty", _C)}),
    "xs_zscore": ({"a": ("ZSCORE($x)", 5)}, {"a": f"(x - avg(x) {_C}) / nullif(stddev_samp(x) {_C}, 0)"}),
    "xs_scale": ({"a": ("SCALE($x)", 8), "b": ("SCALE($qty - 25, 2)", 7)}, {"a": f"x / nullif(sum(abs(x)) {_C}, 0)", "b": f"(qty-25) * 2 / nullif(sum(abs(qty-25)) {_C}, 0)"}),
}

#: Expressions whose SQL needs steps of its own: name -> (expressions, statement over p).
_BY = "SELECT dt, sym, {cols} FROM f GROUP BY dt, sym"
STEPS: dict[str, tuple[dict[str, tuple[str, int | None]], str]] = {
    "ts_rank": ({"a": ("TS_RANK($x, 6)", 8)}, f"{_FRAME} SELECT dt, sym, round(CASE WHEN max(own) IS NOT NULL THEN (count(*) FILTER (y < own) + (count(*) FILTER (y = own) + 1) / 2.0) / count(y) END, 8) AS a FROM f WHERE age < 6 GROUP BY dt, sym"),
    "ts_argmax_argmin": ({"a": ("TS_ARGMAX($x, 6)", 0), "b": ("TS_ARGMIN($x, 6)", 0)}, f"{_FRAME} SELECT dt, sym, CASE WHEN count(y) = count(*) THEN max(age) FILTER (y = m) END::DOUBLE AS a, CASE WHEN count(y) = count(*) THEN max(age) FILTER (y = l) END::DOUBLE AS b FROM (SELECT *, max(y) OVER (PARTITION BY dt, sym) AS m, min(y) OVER (PARTITION BY dt, sym) AS l FROM f WHERE age < 6) GROUP BY dt, sym"),
    "highday_lowday": ({"a": ("HIGHDAY($x, 6)", 0), "b": ("LOWDAY($x, 6)", 0)}, f"{_FRAME} SELECT dt, sym, CASE WHEN count(y) = count(*) THEN 1 + max(age) FILTER (y = m) END::DOUBLE AS a, CASE WHEN count(y) = count(*) THEN 1 + max(age) FILTER (y = l) END::DOUBLE AS b FROM (SELECT *, max(y) OVER (PARTITION BY dt, sym) AS m, min(y) OVER (PARTITION BY dt, sym) AS l FROM f WHERE age < 6) GROUP BY dt, sym"),
    "ts_mad": ({"a": ("TS_MAD($x, 6)", 3)}, f"{_FRAME} SELECT dt, sym, round(CASE WHEN count(y) = count(*) THEN median(abs(y - m)) END, 3) AS a FROM (SELECT *, median(y) OVER (PARTITION BY dt, sym) AS m FROM f WHERE age < 6) GROUP BY dt, sym"),
    "sma_ewm": ({"a": ("SMA($x, 4)", 3), "b": ("SMA($x, 5, 2)", 3)}, f"{_FRAME} SELECT dt, sym, round(avg(y) FILTER (age < 4), 3) AS a, round(sum(y * pow(0.6, age)) / sum(CASE WHEN y IS NOT NULL THEN pow(0.6, age) END), 3) AS b FROM f GROUP BY dt, sym"),
    "ema": ({"a": ("EMA($x, 5)", 3)}, f"{_FRAME} SELECT dt, sym, round(sum(y * pow(1 - 2/6.0, age)) / sum(CASE WHEN y IS NOT NULL THEN pow(1 - 2/6.0, age) END), 3) AS a FROM f GROUP BY dt, sym"),
    "wma": ({"a": ("WMA($x, 6)", 3)}, f"{_FRAME} SELECT dt, sym, round(CASE WHEN count(y) = count(*) THEN sum(y * pow(0.9, age)) / sum(pow(0.9, age)) END, 3) AS a FROM f WHERE age < 6 GROUP BY dt, sym"),
    "decaylinear": ({"a": ("DECAYLINEAR($x, 5)", 3)}, f"{_FRAME} SELECT dt, sym, round(CASE WHEN count(y) = count(*) THEN sum(y * (pos - low + 1)) / 15.0 END, 3) AS a FROM (SELECT *, min(pos) OVER (PARTITION BY dt, sym) AS low FROM f WHERE age < 5) GROUP BY dt, sym"),
    "expr_rank_ts_mean": ({"a": ("RANK(TS_MEAN($price, 5))", 8)}, f"m AS (SELECT dt, sym, round(avg(price) {_w(5)}, 7) AS v FROM p) SELECT dt, sym, round({rank_pct('v')}, 8) AS a FROM m"),
    "expr_ternary": ({"a": ("$qty > MEDIAN($qty) ? TS_MEAN($x, 3) : DELAY($x, 1)", 3)}, f"SELECT dt, sym, round(CASE WHEN qty > median(qty) {_C} THEN avg(x) {_w(3)} ELSE lag(x, 1) {_O} END, 3) AS a FROM p"),
    "expr_sign_median": ({"a": ("(-1 * $qty) * SIGN(MEDIAN($price) - $price)", 6)}, f"SELECT dt, sym, round(-qty * sign(median(price) {_C} - price), 6) AS a FROM p"),
    "expr_corr_product": ({"a": ("RANK(TS_MAX($qty, 4)) * SIGN(TS_MIN($qty, 5) - 20)", 8)}, f"m AS (SELECT dt, sym, max(qty) {_w(4)} AS v, min(qty) {_w(5)} AS u FROM p) SELECT dt, sym, round(({rank_pct('v')}) * sign(u - 20), 8) AS a FROM m"),
    "expr_band_condition": ({"a": ("(($price - TS_MIN($price, 14)) / (TS_MAX($price, 14) - TS_MIN($price, 14) + 1e-8))", 5), "b": ("($price > TS_MEAN($price, 5) && $qty < 30) || $vol > 500", None)}, f"SELECT dt, sym, round((price - min(price) {_w(14)}) / (max(price) {_w(14)} - min(price) {_w(14)} + 1e-8), 5) AS a, (price > avg(price) {_w(5)} AND qty < 30) OR vol > 500 AS b FROM p"),
}


def _round(df: DataFrame, exprs: dict[str, tuple[str, int | None]]) -> DataFrame:
    return df.select("dt", "sym", *[F.col(k) if d is None else rounded(F.col(k), d).alias(k) for k, (_, d) in exprs.items()])


def _query(exprs):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(evaluate(supplier_months(spark, sf_dir), {k: e for k, (e, _) in exprs.items()}, MONTHS), exprs)

    return run


QUERIES = {n: _query(e) for n, (e, _) in {**Q, **STEPS}.items()}
ORACLES = {
    n: f"WITH {PANEL} SELECT dt, sym, " + ", ".join(f"{sql} AS {k}" if e[k][1] is None else f"round({sql}, {e[k][1]}) AS {k}" for k, sql in s.items()) + " FROM p"
    for n, (e, s) in Q.items()
} | {n: f"WITH {PANEL}{', ' if not s.startswith('SELECT') else ' '}{s}" for n, (_, s) in STEPS.items()}
ORACLES = {n: exact_rounds(s) for n, s in ORACLES.items()}

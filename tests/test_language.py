"""Parser, compiler and functions against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.registry import REGISTRY, register
from panelforge.functions.windows import Axes
from panelforge.plans import ast
from panelforge.plans.compiler import evaluate
from panelforge.plans.parser import ExpressionError, fields, parse

AXES = Axes("dt", "sym", None)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    days = [dt.datetime(2020, 1, 1) + dt.timedelta(days=k) for k in range(30)]
    p = pd.DataFrame([(d, s) for s in "abcdef" for d in days], columns=["dt", "sym"])
    p["x"] = rng.integers(0, 12, len(p)) / 4.0
    p["y"] = rng.normal(size=len(p))
    p.loc[rng.random(len(p)) < 0.15, "x"] = np.nan
    return p


@pytest.fixture(scope="module")
def panel(spark, frame):
    return spark.createDataFrame(frame)


def values(df, frame):
    got = df.toPandas().set_index(["sym", "dt"])["v"].astype(float)
    return got.reindex(pd.MultiIndex.from_frame(frame[["sym", "dt"]])).to_numpy()


def rolling(frame, column, p, **kw):
    return frame.groupby("sym")[column].rolling(p, min_periods=kw.pop("min_periods", 1), **kw)


SERIES = {
    "TS_MEAN($x, 5)": lambda f: rolling(f, "x", 5).mean(),
    "TS_SUM($x, 5)": lambda f: rolling(f, "x", 5).sum(),
    "TS_STD($x, 6)": lambda f: rolling(f, "x", 6).std(),
    "TS_MEDIAN($x, 5)": lambda f: rolling(f, "x", 5).median(),
    "TS_QUANTILE($x, 7, 0.3)": lambda f: rolling(f, "x", 7).quantile(0.3),
    "TS_RANK($x, 6)": lambda f: rolling(f, "x", 6).rank(pct=True),
    "EMA($x, 5)": lambda f: f.groupby("sym")["x"].apply(lambda s: s.ewm(span=5, adjust=True, ignore_na=False, min_periods=1).mean()),
    "SMA($x, 4, 1)": lambda f: f.groupby("sym")["x"].apply(lambda s: s.ewm(alpha=0.25, adjust=True).mean()),
    "DELTA($y, 2)": lambda f: f.groupby("sym")["y"].diff(2),
    "WMA($y, 4)": lambda f: rolling(f, "y", 4).apply(lambda a: np.average(a, weights=0.9 ** np.arange(len(a))[::-1]), raw=True),
    "DECAYLINEAR($y, 4)": lambda f: rolling(f, "y", 4).apply(lambda a: a @ np.arange(1, len(a) + 1) / 10, raw=True),
    "TS_ARGMAX($y, 5)": lambda f: rolling(f, "y", 5).apply(lambda a: len(a) - a.argmax() - 1, raw=True),
    "TS_MAD($y, 5)": lambda f: rolling(f, "y", 5).apply(lambda a: np.median(np.abs(a - np.median(a))), raw=True),
    "PROD($y, 3)": lambda f: rolling(f, "y", 3).apply(np.prod, raw=True),
    "TS_CORR($x, $y, 6)": lambda f: pd.concat([g.rolling(6, min_periods=2)["x"].corr(g["y"]).replace([np.inf, -np.inf], np.nan) for _, g in f.groupby("sym")]),
}


@pytest.mark.parametrize("text", SERIES)
def test_series(panel, frame, text):
    want = SERIES[text](frame).to_numpy()
    np.testing.assert_allclose(values(evaluate(panel, {"v": text}, AXES), frame), want, atol=1e-7)


CROSS = {
    "RANK($x)": lambda f: f.groupby("dt")["x"].rank(pct=True),
    "ZSCORE($y)": lambda f: f.groupby("dt")["y"].transform(lambda s: (s - s.mean()) / s.std()),
    "SCALE($y, 2)": lambda f: f.groupby("dt")["y"].transform(lambda s: 2 * s / s.abs().sum()),
    "MEDIAN($x)": lambda f: f.groupby("dt")["x"].transform("median"),
    "RANK(TS_MEAN($y, 3)) - $y": lambda f: f.assign(m=rolling(f, "y", 3).mean().to_numpy()).groupby("dt")["m"].rank(pct=True) - f["y"],
}


@pytest.mark.parametrize("text", CROSS)
def test_cross(panel, frame, text):
    np.testing.assert_allclose(values(evaluate(panel, {"v": text}, AXES), frame), CROSS[text](frame).to_numpy(), atol=1e-9)


def test_precedence():
    c = lambda t: str(parse(t))
    assert c("1 + 2 * $a") == "(1+(2*$a))"
    assert c("-$a * 2") == "((-$a)*2)"
    assert c("$a > 1 && $b < 2 || $c == 3") == "((($a>1)&&($b<2))||($c==3))"
    assert c("$a ? $b : $c ? 1 : 2") == "($a?$b:($c?1:2))"
    assert c("$a - $b - $c") == "(($a-$b)-$c)"
    assert parse("1e-8").value == 1e-8


@pytest.mark.parametrize("text", ["($a", "$a +", "f($a", "$a @ 2", "$a $b", ""])
def test_syntax_errors(text):
    with pytest.raises(ExpressionError):
        parse(text)


@pytest.mark.parametrize("text", ["$nothing + 1", "RSI($x, 5)", "$ret + 1", "$dt", "TS_MEAN($x, 0)", "DELTA($x, -1)", "RANK($x, $y)"])
def test_rejected(spark, frame, text):
    df = spark.createDataFrame(frame.head(3)).withColumn("ret", F.lit(1.0))
    with pytest.raises((ExpressionError, ValueError)):
        evaluate(df, {"v": text}, AXES)


def test_missing_values(spark):
    rows = [(dt.datetime(2020, 1, 1), s, v) for s, v in zip("abcd", [1.0, float("nan"), None, float("inf")])]
    df = evaluate(spark.createDataFrame(rows, "dt timestamp_ntz, sym string, x double"), {"a": "RANK($x)", "b": "$x > 0", "c": "$x != 1", "d": "$x / 0", "e": "MAX($x, 5)", "f": "SQRT(-$x)", "g": "LOG($x - 9)"}, AXES)
    got = {r["sym"]: r for r in df.collect()}
    assert got["a"]["a"] == 1.0 and got["b"]["a"] is None and got["d"]["a"] is None
    assert [got[s]["b"] for s in "abcd"] == [True, False, False, False]
    assert [got[s]["c"] for s in "abcd"] == [False, True, True, True]
    assert all(got["a"][k] is None for k in "dfg") and got["a"]["e"] == 5.0 and got["c"]["e"] is None


def test_sessions_do_not_mix(spark):
    rows = [(d, m, "a", float(10 * d + m)) for d in (1, 2) for m in (1, 2, 3)]
    df = spark.createDataFrame(rows, "date int, minute int, sym string, x double")
    got = {(r["date"], r["minute"]): r["v"] for r in evaluate(df, {"v": "DELAY($x, 1)"}, Axes("minute", "sym", "date")).collect()}
    assert got[2, 1] is None and got[2, 2] == 21.0


def test_equal_subtrees_are_made_once(panel):
    text = evaluate(panel, {"v": "TS_MEAN($x, 5) + TS_MEAN($x, 5)", "w": "RANK(TS_MEAN($x, 5))"}, AXES)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("avg(") == 1


def test_registering(panel, frame):
    register("TWICE", "scalar")(lambda ax, x: x * 2)
    try:
        np.testing.assert_allclose(values(evaluate(panel, {"v": "TWICE($y)"}, AXES), frame), 2 * frame["y"])
    finally:
        del REGISTRY["TWICE"]


def test_measures():
    n = parse("RANK($a * 2) + $b")
    assert ast.measures(n, "RANK($a * 2) + $b") == {"symbol_length": 13, "nodes": 6, "numbers": 1, "unique_vars": 2, "vars": 2}
    assert ast.common_subtree(parse("$b * $a + 1"), parse("RANK($a * $b)")) == (3, "($a*$b)")
    assert ast.acceptable(n, "RANK($a * 2) + $b", [n])["accepted"]
    assert ast.acceptable(n, "RANK($a * 2) + $b", [n], max_dup=2)["reasons"] == ["overlap"]
    assert fields(n) == ["a", "b"]

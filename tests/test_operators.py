"""Properties and edge rows of the operators."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.windows import Axes
from panelforge.operators import backtest, bars, evaluate, joins, knowledge, model, prep
from panelforge.sources import panel as src
from panelforge.sources import sinks
from panelforge.streaming.bars import incremental_days, streaming_bars

AXES = Axes("dt", "sym", None)


def panel(spark, times, symbols, f, r):
    day = dt.datetime(2021, 1, 4)
    rows = [(day + dt.timedelta(days=t), f"s{s:02d}", f(t, s), r(t, s)) for t in range(times) for s in range(symbols)]
    return spark.createDataFrame(rows, "dt timestamp_ntz, sym string, f double, ret double")


def test_perfect_factor(spark):
    rng = np.random.default_rng(0).normal(size=(3, 30))
    m = backtest.minute_metrics(panel(spark, 3, 30, lambda t, s: float(rng[t, s]), lambda t, s: float(rng[t, s]))).collect()
    for r in m:
        assert r["n_obs"] == 30 and r["ic"] == pytest.approx(1) and r["rankic"] == pytest.approx(1)
        assert r["decile_1_ret"] < r["decile_10_ret"] and r["turnover"] is None


def test_rank_ic_is_spearman_with_holes(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(4, 40)), rng.normal(size=(4, 40))
    hole = rng.random((2, 4, 40)) < 0.1
    none = lambda x, h: None if h else float(x)
    m = {r["dt"]: r for r in backtest.minute_metrics(panel(spark, 4, 40, lambda t, s: none(a[t, s], hole[0, t, s]), lambda t, s: none(b[t, s], hole[1, t, s]))).collect()}
    for t, (_, r) in enumerate(sorted(m.items())):
        ok = ~(hole[0, t] | hole[1, t])
        want = np.corrcoef(pd.Series(a[t, ok]).rank(), pd.Series(b[t, ok]).rank())[0, 1]
        assert r["rankic"] == pytest.approx(want) and r["n_obs"] == ok.sum()


def test_turnover_with_gaps(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=(16, 23))
    gone = rng.random((16, 23)) < 0.2
    df = panel(spark, 16, 23, lambda t, s: None if gone[t, s] or t == 5 else float(f[t, s]), lambda t, s: 1.0 * s).where("not (sym = 's03' and dt > '2021-01-10')")
    got = {r["dt"]: r["turnover"] for r in backtest.minute_metrics(df, hold=4).collect()}
    assert len(got) == 15  # the time without a factor is no cross-section
    wide = df.toPandas().pivot(index="dt", columns="sym", values="f").drop(index=pd.Timestamp("2021-01-09"))
    sig = []
    for _, row in wide.iterrows():
        rank, n = row.rank(), row.count()
        dec = np.clip(np.ceil(rank * 10 / n), 1, 10)
        sig.append((dec == 10) / (2 * max((dec == 10).sum(), 1)) * 1.0 - (dec == 1) / (2 * max((dec == 1).sum(), 1)))
    for k, t in enumerate(wide.index):
        want = None if k < 4 else float((sig[k] - sig[k - 4]).abs().sum() / 8)
        assert got[t.to_pydatetime()] == (want if want is None else pytest.approx(want))


def test_flat_and_thin_sections(spark):
    m = backtest.minute_metrics(panel(spark, 2, 12, lambda t, s: 1.0 if t == 0 else float(s), lambda t, s: 0.5)).orderBy("dt").collect()
    assert m[0]["ic"] is None and m[0]["rankic"] is None and m[1]["ic"] is None
    one = backtest.minute_metrics(panel(spark, 1, 1, lambda t, s: 1.0, lambda t, s: 0.5)).first()
    assert one["n_obs"] == 1 and one["ic"] is None


def test_summary_uses_the_calendar(spark):
    days = pd.bdate_range("2024-01-01", periods=5)
    make = lambda ds: spark.createDataFrame([(d.to_pydatetime(), 0.1 * k, 0.1, 0.01, -0.01, 0.01 + 0.001 * k, 0.05) for k, d in enumerate(ds)], "dt timestamp_ntz, ic double, rankic double, long_ret double, short_ret double, long_short_ret double, turnover double")
    full, sparse = backtest.summarise(make(days), "dt").first(), backtest.summarise(make(days[[0, 4]]), "dt").first()
    assert full["long_ret"] == pytest.approx(0.01 * 252) and sparse["long_ret"] == pytest.approx(0.01 * 2 / 5 * 252)
    assert full["sharpe"] == pytest.approx(full["long_short_ret"] / full["volatility"])
    assert full["RankICIR"] is None  # no variance


def test_universe(spark, tmp_path):
    doc = {"universe": [
        {"ticker": "AAA", "wrds_sym_root": "AAA", "wrds_sym_suffix": None, "in_date": "2020-01-01", "out_date": None},
        {"ticker": "BBB", "wrds_sym_root": "BBB", "wrds_sym_suffix": None, "in_date": "2020-01-01", "out_date": "2025-06-30"},
        {"ticker": "CCC.B", "wrds_sym_root": "CCC", "wrds_sym_suffix": "B", "in_date": "2020-01-01", "out_date": None},
        {"ticker": "DDD", "wrds_sym_root": "DDD", "wrds_sym_suffix": None, "in_date": "2025-07-01", "out_date": None},
    ]}
    (tmp_path / "u.json").write_text(json.dumps(doc))
    u = src.read_universe(spark, str(tmp_path / "u.json"))
    rows = [(d, r, s) for d in ("2025-06-29", "2025-06-30", "2025-07-01") for r, s in (("AAA", None), ("BBB", "None"), ("CCC", "B"), ("DDD", ""), ("ZZZ", None))]
    p = spark.createDataFrame(rows, "date string, sym_root string, sym_suffix string").withColumn("sym_suffix", src.canonical_suffix(F.col("sym_suffix")))
    got = {(r["date"], r["sym_root"]) for r in joins.pit_members(p, u, ["sym_root", "sym_suffix"], F.to_date("date")).collect()}
    assert got == {(d, s) for d in ("2025-06-29", "2025-06-30", "2025-07-01") for s in ("AAA", "CCC")} | {("2025-06-29", "BBB"), ("2025-07-01", "DDD")}


def test_readers(spark, tmp_path):
    wide = pd.DataFrame({"Datetime": pd.to_datetime(["2025-01-02 09:31", "2025-01-02 10:05"]), "A": [1.0, np.nan], "B": [3.0, 4.0]})
    long = {(r["minute"], r["ticker"]): r["v"] for r in src.wide_to_long(spark.createDataFrame(wide), "Datetime", "v").collect()}
    assert long == {(931, "A"): 1.0, (931, "B"): 3.0, (1005, "B"): 4.0}
    (tmp_path / "c.csv").write_text("x,trade_date\n1,20250102\n2,2025-01-03\n")
    assert [r["date"] for r in src.read_calendar(spark, str(tmp_path / "c.csv")).orderBy("date").collect()] == [dt.date(2025, 1, 2), dt.date(2025, 1, 3)]
    import pyarrow as pa
    import pyarrow.feather

    pyarrow.feather.write_feather(pa.table({"a": [1, 2]}), str(tmp_path / "t.feather"))
    assert src.read_feather(spark, str(tmp_path / "t.feather")).count() == 2
    df = spark.createDataFrame([("A", None), ("A", "None"), ("A", "B")], "sym_root string, sym_suffix string")
    assert [r[0] for r in df.select(src.ticker()).collect()] == ["A", "A", "A.B"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "days")
    df = lambda d, v: spark.createDataFrame([(d, v)], "date string, v int")
    sinks.write_days(df("2025-01-02", 1), path)
    sinks.write_days(df("2025-01-03", 2), path)
    sinks.write_days(df("2025-01-02", 3), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2, 3]
    with pytest.raises(PermissionError):
        sinks.write_days(df("2025-01-02", 1), str(tmp_path / "ro/../ro/x"), (str(tmp_path / "ro"),))


def test_catalog(spark):
    p = spark.createDataFrame([("d", 1, 1.0, 2.0)], "date string, minute int, a double, b double")
    own = spark.createDataFrame([("d", 2, 9.0)], "date string, minute int, b double")
    c = src.FeatureCatalog(p, {"b": own}, ("date", "minute"))
    assert c.fields() == ["b", "a"]
    assert {(r["minute"], r["a"], r["b"]) for r in c.load(["a", "b"]).collect()} == {(1, 1.0, None), (2, None, 9.0)}
    with pytest.raises(KeyError):
        c.load(["c"])


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(Exception, match="keys repeat"):
        joins.many_to_one(left, spark.createDataFrame([(1, 1), (1, 2)], "k int, w int"), ["k"]).collect()
    assert {(r["k"], r["w"]) for r in joins.many_to_one(left, spark.createDataFrame([(1, 1)], "k int, w int"), ["k"]).collect()} == {(1, 1), (2, None)}
    a = spark.createDataFrame([(1,), (5,), (7,)], "t int")
    b = spark.createDataFrame([(5, 1.0), (6, None), (9, 2.0)], "t int, v double")
    assert {(r["t"], r["v"]) for r in joins.asof_backward(a, b, "t", [], "v").collect()} == {(1, None), (5, 1.0), (7, 1.0)}
    assert [r["split"] for r in joins.split_by_ratio(a, "t", 0.9, 0.9).orderBy("t").collect()] == ["train", "train", "test"]
    assert [r["split"] for r in joins.split_by_ratio(a, "t", 0.4, 0.4).orderBy("t").collect()] == ["train", "valid", "test"]


def test_labels(spark):
    df = panel(spark, 14, 3, lambda t, s: 0.0, lambda t, s: 0.0).withColumn("p", F.dayofmonth("dt") + 1.0)
    got = bars.forward_labels(df.drop("ret"), "p", AXES)
    assert got.where("ret is not null").count() == 12
    assert got.agg(F.max(F.abs("ex_ret"))).first()[0] == pytest.approx(0)


def test_time(spark):
    df = spark.createDataFrame([("09:30:00.5",), ("10:05:59",), ("x",), (None,)], "t string")
    got = df.select(bars.tick_ns(F.col("t")).alias("n")).select("n", bars.ns_minute(F.col("n")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(34_200_500_000_000, 930), (36_359_000_000_000, 1005), (None, None), (None, None)]


def test_preparation(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(2, 20))
    df = panel(spark, 2, 20, lambda t, s: None if s == 3 else 7.0 if t == 1 else float(v[t, s]), lambda t, s: float(s))
    got = prep.winsor_zscore(df, AXES, ["f"], 0.1).toPandas().sort_values(["dt", "sym"])
    first = pd.Series([np.nan if s == 3 else v[0, s] for s in range(20)])
    c = first.clip(first.quantile(0.1), first.quantile(0.9))
    np.testing.assert_allclose(got["f"][:20].to_numpy(float), ((c - c.mean()) / c.std()).fillna(0), atol=1e-9)
    flat = got["f"][20:].to_numpy(float)
    assert np.isnan(flat[3]) and (np.delete(flat, 3) == 0).all()
    with pytest.raises(ValueError):
        prep.training_label(df, AXES, "ret", "no", ["dt"])


def test_ridge(spark):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(200, 3))
    y = X @ [1.0, -2.0, 0.5] + 3 + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, x), float(t)) for x, t in zip(X, y)], "a double, b double, c double, y double")
    w, b = model.Moments.of(df, ["a", "b", "c"], "y").ridge(2.0)
    Xc = X - X.mean(0)
    want = np.linalg.solve(Xc.T @ Xc + 2 * np.eye(3), Xc.T @ (y - y.mean()))
    np.testing.assert_allclose(w, want, atol=1e-10)
    assert b == pytest.approx(y.mean() - X.mean(0) @ want)
    alpha, *_ = model.fit(df.where("a < 0"), df.where("a >= 0"), ["a", "b", "c"], "y")
    assert alpha in model.ALPHAS
    got = model.rank_ic(df, "y", ["a"])[0]
    assert got == pytest.approx(np.corrcoef(pd.Series(y).rank(), pd.Series(X[:, 0]).rank())[0, 1])
    with pytest.raises(ValueError):
        model.Moments.of(df.where("a > 99"), ["a"], "y")


def test_comparison_and_graph(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    c = evaluate.compare(a, a, ["k"], "v").first()
    assert c["equal_share"] == 1.0 and c["differing"] == 0 and c["key_jaccard"] == 1.0
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    start, block = spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("b",)], "node string")
    assert {(r["node"], r["step"]) for r in knowledge.within_steps(e, start, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r["node"] for r in knowledge.within_steps(e, start, 3, block).collect()} == {"a", "b"}


def test_streaming_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 9, 30)
    rows = [(t0 + dt.timedelta(seconds=20 * k), "ab"[k % 2], float(k % 7)) for k in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, sym string, v double")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming_bars(s, "ts", "sym", "v").writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    done = {tuple(r) for r in spark.table("bars").collect()}
    batch = {tuple(r) for r in streaming_bars(df, "ts", "sym", "v").collect()}
    assert done and done <= batch  # the last windows stay open behind the watermark
    for _ in range(2):
        incremental_days(s, str(tmp_path / "out"), str(tmp_path / "state"), lambda b: b.withColumn("date", F.to_date("ts")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_moments_of_a_feature_named_n(spark):
    from panelforge.operators.model import Moments

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    y = x @ np.arange(8) + rng.normal(size=200)
    names = ["n", *(f"f{k}" for k in range(7))]
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*names, "y"]))
    for k in (2, 8):  # columns in a plan, and partial matrices
        m = Moments.of(df, names[:k], "y")
        c = x[:, :k] - x[:, :k].mean(0)
        np.testing.assert_allclose(m.ridge(3.0)[0], np.linalg.solve(c.T @ c + 3 * np.eye(k), c.T @ (y - y.mean())), rtol=1e-9)
        assert m.n == 200


def test_rank_ic_of_several_columns(spark):
    from panelforge.operators.model import rank_ic

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"y": rng.integers(0, 50, 700).astype(float), "a": rng.normal(size=700), "b": rng.integers(0, 5, 700).astype(float)})
    pdf["a"] += pdf["y"] / 20
    pdf.loc[::7, "b"] = np.nan
    got = rank_ic(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "y double, a double, b double"), "y", ["a", "b"])
    want = [pdf[["y", c]].dropna().rank().corr().iloc[0, 1] for c in ("a", "b")]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_long_series_and_sums(spark):
    """EMA over more rows than a chunk holds, with holes; a sum of many terms."""
    from panelforge.functions.windows import Axes
    from panelforge.plans.compiler import evaluate

    rng = np.random.default_rng(0)
    v = rng.normal(size=900)
    v[rng.random(900) < 0.3] = np.nan
    pdf = pd.DataFrame({"dt": range(900), "sym": 1, "x": v})
    got = evaluate(spark.createDataFrame(pdf), {"a": "EMA($x, 1.5)", "b": "SMA($x, 5, 2)", "c": "$x" + " + $x" * 40}, Axes("dt", "sym")).toPandas().sort_values("dt")
    for c, keep in (("a", 0.2), ("b", 0.6)):
        top = total = 0.0
        want = []
        for x in v:
            top, total = top * keep + (x if x == x else 0), total * keep + (x == x)
            want.append(top / total if total else np.nan)
        np.testing.assert_allclose(got[c].astype(float), want, rtol=1e-12)
    np.testing.assert_allclose(got["c"].astype(float), 41 * v)


def test_asof_without_keys(spark):
    from panelforge.operators.joins import asof_backward

    rng = np.random.default_rng(1)
    left, right = sorted(rng.integers(0, 5000, 400).tolist()), {int(t): float(i) for i, t in enumerate(rng.choice(5000, 90, replace=False))}
    got = asof_backward(spark.createDataFrame([(t,) for t in left], "t long"), spark.createDataFrame(list(right.items()), "t long, v double"), "t", [], "v").collect()
    want = sorted((t, right[max(k for k in right if k <= t)] if any(k <= t for k in right) else None) for t in left)
    assert sorted((r["t"], r["v"]) for r in got) == want


def test_fixed_weight_correlation(spark):
    from panelforge.functions.registry import corr_with
    from panelforge.functions.windows import Axes

    v = [1.0, 4.0, None, 2.0, 8.0, 8.0, 8.0, 8.0]
    df = spark.createDataFrame([(i, 1, x) for i, x in enumerate(v)], "dt int, sym int, x double")
    got = [r["c"] for r in df.select("dt", corr_with(Axes("dt", "sym"), F.col("x"), [1.0, 2.0, 4.0]).alias("c")).orderBy("dt").collect()]
    want = [np.corrcoef([8.0, 2.0], [4.0, 2.0])[0, 1]]
    assert got[0] is None and got[1] == pytest.approx(1.0) and got[4] == pytest.approx(want[0]) and got[6] == 0 == got[7]


def test_layouts_and_model_files(spark, tmp_path):
    from panelforge.sources import panel as src
    from panelforge.sources.sinks import read_model, write_model

    spark.sql("select date'2025-01-02' date, 'A' sym_root, '' sym_suffix, 931 minute, 1.0 v").write.parquet(str(tmp_path / "long"))
    spark.sql("select timestamp_ntz'2025-01-02 09:31:00' Datetime, 1.0 A").write.parquet(str(tmp_path / "wide"))
    assert src.open_table(spark, str(tmp_path / "long"))[1] == {"layout": "long", "time": "date", "format": "parquet"}
    assert src.open_table(spark, str(tmp_path / "wide"))[1] == {"layout": "wide", "time": "Datetime", "format": "parquet"}
    assert src.FeatureCatalog.merged(["a", " b"], ["b", "", "c"]) == ["a", "b", "c"]
    (tmp_path / "s.csv").write_text("factor,ic\na,0.1\n")
    assert src.read_summary(spark, str(tmp_path / "s.csv")).first()["factor"] == "a"
    write_model(spark, str(tmp_path / "m"), {"a": 0.5, "b": -2.0}, {"alpha": "10"})
    assert read_model(spark, str(tmp_path / "m")) == ({"b": -2.0, "a": 0.5}, {"alpha": "10"})


def test_batches_tried_again_replace_themselves(spark, tmp_path):
    """A lost commit makes the stream give its batch again."""
    import shutil

    from panelforge.streaming.bars import incremental_days

    spark.sql("select date'2025-01-02' date, id from range(5)").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental_days(spark.readStream.schema("date date, id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), lambda b: b)
        shutil.rmtree(tmp_path / "check" / "commits")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_search_computes_features_once(spark):
    """One pass over each part, however many alphas there are and whatever a feature costs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 7))
    y = x @ np.arange(7) + rng.normal(size=300)
    names = [f"f{k}" for k in range(7)]
    rows = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*names, "y"])).withColumn("part", F.monotonically_increasing_id() % 3)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(v):
        seen.add(1)
        return v

    wide = rows.withColumn("f0", costly.asNondeterministic()("f0"))
    found = dict(model.search(wide.where("part > 0").drop("part"), wide.where("part = 0").drop("part"), names, "y"))
    assert seen.value <= 2 * 300  # each part's filter may come behind the feature
    pdf = rows.toPandas()
    train, valid = pdf[pdf.part > 0], pdf[pdf.part == 0]
    c, t = train[names] - train[names].mean(), train.y - train.y.mean()
    for alpha, r in found.items():
        w = np.linalg.solve(c.T @ c + alpha * np.eye(7), c.T @ t)
        assert r == pytest.approx(np.corrcoef((valid[names] @ w).rank(), valid.y.rank())[0, 1])


def test_spearman_over_many_blocks_and_ranges(spark):
    from panelforge.operators.ranks import spearman

    rng = np.random.default_rng(9)
    n = 3000
    pdf = pd.DataFrame({"y": rng.integers(0, 40, n) / 4 - 5, "a": rng.normal(size=n), "b": rng.integers(-3, 3, n).astype(float), "c": np.where(rng.random(n) < 0.9, 1.0, rng.normal(size=n)), "same": 2.0, "none": np.nan})
    pdf["a"] += pdf["y"] / 5
    pdf.loc[::7, "b"] = np.nan
    pdf.loc[::11, "c"] = np.nan
    pdf.loc[::13, "y"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf.columns)).repartition(5)
    got = spearman(df, "y", ["a", "b", "c", "same", "none"], block_rows=600, range_rows=90)
    want = [pdf[["y", c]].dropna().rank().corr().iloc[0, 1] for c in ("a", "b", "c")]
    np.testing.assert_allclose(got[:3], want, rtol=1e-9)
    assert np.isnan(got[3:]).all() and np.isnan(spearman(df.where("a > 99"), "y", ["a", "b"])).all()
    # NaN is a value, the largest; -0.0 equals 0.0
    odd = spark.createDataFrame([(1.0, 0.0), (2.0, -0.0), (3.0, float("inf")), (4.0, float("nan")), (5.0, float("nan")), (0.5, -float("inf"))], "y double, p double")
    assert spearman(odd, "y", ["p"])[0] == pytest.approx(np.corrcoef([2, 3, 4, 5, 6, 1], [2.5, 2.5, 4, 5.5, 5.5, 1])[0, 1])

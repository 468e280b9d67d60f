"""Queries of the operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sqltext import PANEL, exact_rounds, rounded
from ..functions.windows import Axes, div
from ..plans import ast, parser
from ..sources import panel as src
from ..sources.sinks import factor_id, upsert
from . import backtest, bars, evaluate, joins, knowledge, model, prep

M = src.MONTHS
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = exact_rounds(sql)
        return f

    return add


def out(df: DataFrame, *keys: str, **digits: int) -> DataFrame:
    return df.select(*keys, *[rounded(F.col(c), d).alias(c) for c, d in digits.items()])


# -- ticks, bars, labels -------------------------------------------------------------

QUOTES = """q AS (SELECT CAST(ts AS DATE) AS date, event_type AS sym_root, value AS bid, value + 0.01 * (event_id % 7) AS ask,
 (user_id % 13)::DOUBLE AS bs, (event_id % 11)::DOUBLE AS a_s, epoch_us(ts) % 86400000000 * 1000 AS ns,
 (hour(ts) * 100 + minute(ts))::INT AS minute FROM events),
v AS (SELECT *, ask - bid AS spread, (bid + ask) * 0.5 AS mid, (bs - a_s) / nullif(bs + a_s, 0) AS imb FROM q
 WHERE minute BETWEEN 930 AND 1559 AND minute % 100 < 60 AND bid > 0 AND ask > 0 AND bid <= ask)"""


def _quotes(spark, d):
    return bars.valid_quotes(src.quotes(spark, d))


@query("tick_time_parse", "SELECT event_id, (epoch_us(ts) % 86400000000 * 1000)::BIGINT AS ns, (hour(ts) * 100 + minute(ts))::INT AS minute FROM events")
def tick_time(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events").select("event_id", F.date_format("ts", "HH:mm:ss.SSSSSS").alias("t"))
    return e.select("event_id", bars.tick_ns(F.col("t")).alias("ns")).withColumn("minute", bars.ns_minute(F.col("ns")))


@query("session_filter", f"WITH {QUOTES} SELECT date, sym_root, minute, round(spread, 6) AS spread, round(mid, 6) AS mid, round(imb, 6) AS imb FROM v")
def session(spark, d):
    return out(_quotes(spark, d), "date", "sym_root", "minute", spread=6, mid=6, imb=6)


@query("minute_sampling", "SELECT event_id, (hour(ts) * 100 + minute(ts))::INT AS minute FROM events WHERE hour(ts) * 100 + minute(ts) BETWEEN 930 AND 1559 AND (hour(ts) * 60 + minute(ts) - 570) % 15 = 0")
def sampling(spark, d):
    m = (F.hour("ts") * 100 + F.minute("ts")).cast("int")
    return src.table(spark, d, "events").select("event_id", m.alias("minute")).where(bars.sampled(F.col("minute"), 15))


_BAR = ", ".join(
    f"round(arg_min({c}, ns), 6) AS {n}_first, round(arg_max({c}, ns), 6) AS {n}_last, round(max({c}), 6) AS {n}_max, round(min({c}), 6) AS {n}_min, round(avg({c}), 5) AS {n}_mean, round(stddev_samp({c}), 5) AS {n}_std"
    for c, n in (("spread", "spread"), ("mid", "mid_price"))
)


@query("minute_bars", f"WITH {QUOTES} SELECT date, sym_root, minute // 100 AS hour, {_BAR}, round(avg(imb), 5) AS imbalance_mean, round(stddev_samp(imb), 5) AS imbalance_std, count(*)::BIGINT AS n_ticks FROM v GROUP BY ALL")
def minute_bars(spark, d):
    b = bars.minute_bars(_quotes(spark, d).withColumn("hour", F.expr("minute div 100").cast("int")), ["date", "sym_root", "hour"])
    digits = {f"{n}_{k}": 5 if k in ("mean", "std") else 6 for n in ("spread", "mid_price") for k in ("first", "last", "max", "min", "mean", "std")}
    return out(b, "date", "sym_root", "hour", "n_ticks", **digits, imbalance_mean=5, imbalance_std=5)


@query(
    "time_weighted_spread",
    f"""WITH {QUOTES}, t AS (SELECT date, sym_root, minute // 100 AS hour, spread, (coalesce(lead(ns) OVER (PARTITION BY date, sym_root, minute // 100 ORDER BY ns), (minute // 100 + 1) * 3600000000000) - ns)::DOUBLE AS w FROM v),
c AS (SELECT date, sym_root, hour, round(spread * 100, 0) AS cent, sum(w) AS w, sum(w * spread) AS s FROM t GROUP BY ALL)
SELECT date, sym_root, hour, round(sum(s) / sum(w), 6) AS tw_mean, round(sum(w * w) / (sum(w) * sum(w)), 6) AS hhi FROM c GROUP BY ALL""",
)
def time_weighted(spark, d):
    q = _quotes(spark, d).withColumn("hour", F.expr("minute div 100").cast("int"))
    r = bars.duration_stats(q, ["date", "sym_root", "hour"], (F.col("hour") + 1).cast("bigint") * 3_600_000_000_000)
    return out(r, "date", "sym_root", "hour", tw_mean=6, hhi=6)


_AHEAD = "lead(price, 10) OVER (PARTITION BY sym ORDER BY dt) / price - 1"


@query("forward_label", f"WITH {PANEL} SELECT dt, sym, round({_AHEAD}, 8) AS ret, round(ln(lead(price, 10) OVER (PARTITION BY sym ORDER BY dt) / price), 8) AS log_ret FROM p")
def forward(spark, d):
    return out(bars.forward_labels(src.supplier_months(spark, d), "price", M), "dt", "sym", ret=8, log_ret=8)


@query("excess_label", f"WITH {PANEL}, l AS (SELECT dt, sym, {_AHEAD} AS r FROM p) SELECT dt, sym, round(r - avg(r) OVER (PARTITION BY dt), 7) AS ex_ret FROM l")
def excess(spark, d):
    return out(bars.forward_labels(src.supplier_months(spark, d), "price", M), "dt", "sym", ex_ret=7)


_TICKS = f"""{QUOTES}, t1 AS (SELECT *, minute // 100 AS hour, mid - lag(mid) OVER (PARTITION BY date, minute // 100, sym_root ORDER BY ns) AS move FROM v),
t2 AS (SELECT *, sign(move) * sign(lag(move) OVER (PARTITION BY date, hour, sym_root ORDER BY ns)) < 0 AS turned FROM t1)"""


@query("intraday_features", f"""WITH {_TICKS} SELECT sym_root, hour, round(covar_pop(move, imb) / nullif(var_pop(CASE WHEN move IS NOT NULL THEN imb END), 0), 5) AS kyle_lambda,
 count(*) FILTER (turned) AS reversals, round(avg((imb > 0)::INT), 6) AS imbalance_pos_ratio, round(quantile_cont(spread, 0.75) - quantile_cont(spread, 0.25), 6) AS spread_iqr FROM (
 SELECT sym_root, minute // 100 AS hour, spread, imb, mid - lag(mid) OVER w AS move, sign(mid - lag(mid) OVER w) * lag(s) OVER w < 0 AS turned FROM (SELECT *, sign(mid - lag(mid) OVER (PARTITION BY sym_root, minute // 100 ORDER BY ns)) AS s FROM (SELECT * REPLACE (epoch_ns(date) + ns AS ns) FROM v)) WINDOW w AS (PARTITION BY sym_root, minute // 100 ORDER BY ns)) GROUP BY ALL""")
def intraday(spark, d):
    q = _quotes(spark, d).withColumn("hour", F.expr("minute div 100").cast("int")).withColumn("ns", F.unix_date("date").cast("bigint") * 86_400_000_000_000 + F.col("ns"))
    return out(bars.intraday_features(q, ["sym_root", "hour"]), "sym_root", "hour", "reversals", kyle_lambda=5, imbalance_pos_ratio=6, spread_iqr=6)


# -- joins -----------------------------------------------------------------------------

BASE = f"{PANEL}, b AS (SELECT dt, sym, price, qty, vol, n, x, x AS f, round({_AHEAD}, 8) AS ret FROM p)"


def base(spark, d) -> DataFrame:
    l = bars.forward_labels(src.supplier_months(spark, d), "price", M).withColumn("ret", rounded(F.col("ret"), 8))
    return l.withColumn("f", F.col("x")).select("dt", "sym", "price", "qty", "vol", "n", "x", "f", "ret")


@query("join_factor_label", f"WITH {BASE} SELECT a.dt, a.sym, a.f, b.ret FROM (SELECT dt, sym, f FROM b WHERE f IS NOT NULL) a JOIN (SELECT dt, sym, ret FROM b WHERE ret IS NOT NULL) b USING (dt, sym)")
def join_label(spark, d):
    b = base(spark, d)
    return joins.chain([b.select("dt", "sym", "f").where("f is not null"), b.select("dt", "sym", "ret").where("ret is not null")], ["dt", "sym"])


@query("join_multi_inner", f"WITH {BASE} SELECT a.dt, a.sym, a.f, q.qty, v.vol FROM (SELECT dt, sym, f FROM b WHERE f > 30000) a JOIN (SELECT dt, sym, qty FROM b WHERE qty > 20) q USING (dt, sym) JOIN (SELECT dt, sym, vol FROM b WHERE vol > 100) v USING (dt, sym)")
def join_multi(spark, d):
    b = base(spark, d)
    return joins.chain([b.select("dt", "sym", "f").where("f > 30000"), b.select("dt", "sym", "qty").where("qty > 20"), b.select("dt", "sym", "vol").where("vol > 100")], ["dt", "sym"])


@query("join_full_outer", f"WITH {BASE} SELECT coalesce(a.dt, q.dt) AS dt, coalesce(a.sym, q.sym) AS sym, a.f, q.qty FROM (SELECT dt, sym, f FROM b WHERE f > 36000) a FULL JOIN (SELECT dt, sym, qty FROM b WHERE qty > 25) q ON a.dt = q.dt AND a.sym = q.sym")
def join_outer(spark, d):
    b = base(spark, d)
    features = {"f": b.select("dt", "sym", "f").where("f > 36000"), "qty": b.select("dt", "sym", "qty").where("qty > 25")}
    return src.FeatureCatalog(None, features, ("dt", "sym")).load(["f", "qty"])


@query("join_left_many_to_one", f"WITH {PANEL} SELECT dt, sym, price, s_nationkey FROM p LEFT JOIN supplier ON sym = s_suppkey AND s_acctbal > 0")
def join_left(spark, d):
    s = src.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("sym"), "s_nationkey")
    return joins.many_to_one(src.supplier_months(spark, d).select("dt", "sym", "price"), s, ["sym"])


@query("semi_universe", "SELECT DISTINCT l_suppkey AS sym FROM lineitem WHERE l_quantity > 45 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def semi(spark, d):
    l = src.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("sym"))
    return l.join(src.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("sym")), "sym", "left_semi").distinct()


@query("anti_pending", f"WITH {PANEL} SELECT DISTINCT dt FROM p WHERE dt NOT IN (SELECT DISTINCT dt FROM p WHERE year(dt) < 1998)")
def anti(spark, d):
    p = src.supplier_months(spark, d)
    return joins.pending(p, p.where(F.year("dt") < 1998), "dt")


@query("range_pit", f"""WITH {PANEL}, u AS (SELECT s_suppkey AS sym, CASE WHEN s_suppkey % 4 = 3 THEN DATE '1999-01-01' ELSE DATE '1900-01-01' END AS i,
 CASE s_suppkey % 4 WHEN 1 THEN DATE '1998-06-01' WHEN 2 THEN NULL ELSE DATE '2100-01-01' END AS o FROM supplier)
SELECT dt, p.sym, price FROM p JOIN u ON p.sym = u.sym AND dt >= i AND (o IS NULL OR dt < o)""")
def pit(spark, d):
    return joins.pit_members(src.supplier_months(spark, d).select("dt", "sym", "price"), src.universe(spark, d), ["sym"], F.col("dt").cast("date"))


@query("asof_daily", f"""WITH {PANEL}, o AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS dt, round(avg(o_totalprice), 4) AS v FROM orders WHERE year(o_orderdate) > 1995 GROUP BY 1)
SELECT p.dt, p.sym, o.v FROM p ASOF LEFT JOIN o ON p.dt >= o.dt""")
def asof(spark, d):
    o = src.table(spark, d, "orders").where(F.year("o_orderdate") > 1995).groupBy(F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("dt")).agg(rounded(F.avg("o_totalprice"), 4).alias("v"))
    p = src.supplier_months(spark, d).select("dt", "sym")
    # The series is aligned to the distinct months once, then joined by month.
    return p.join(joins.asof_backward(p.select("dt").distinct(), o, "dt", [], "v"), "dt").select("dt", "sym", "v")


@query("day_pairing", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def pairing(spark, d):
    a = src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return a.join(src.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct(), "date")


# -- sets, order ---------------------------------------------------------------------


@query("union_all", "SELECT o_orderkey AS k, 'o' AS s FROM orders UNION ALL SELECT l_orderkey, 'l' FROM lineitem WHERE l_quantity > 40")
def union(spark, d):
    return src.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("o").alias("s")).unionByName(src.table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("k"), F.lit("l").alias("s")))


def _days(spark, d):
    return src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")), src.table(spark, d, "events").select(F.to_date("ts").alias("date"))


_A, _E = "SELECT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus = 'F'", "SELECT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice > 300000"


def _two(spark, d):
    o = src.table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("date")), o.where("o_totalprice > 300000").select(F.to_date("o_orderdate").alias("date"))


@query("intersect_dates", f"{_A} INTERSECT {_E}")
def intersect(spark, d):
    a, b = _two(spark, d)
    return a.intersect(b)


@query("except_dates", f"{_A} EXCEPT {_E}")
def except_(spark, d):
    a, b = _two(spark, d)
    return a.subtract(b)


@query("symmetric_diff", f"(({_A}) EXCEPT ({_E})) UNION (({_E}) EXCEPT ({_A}))")
def sym_diff(spark, d):
    return joins.symmetric_difference(*_two(spark, d))


@query("distinct_symbols", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct(spark, d):
    return src.table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("topk_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 4500) DESC, c_custkey LIMIT 20")
def topk(spark, d):
    return src.table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs(F.col("c_acctbal") - 4500).desc(), "c_custkey").limit(20)


@query("recent_days", f"WITH {PANEL} SELECT dt, sym, price FROM p WHERE dt IN (SELECT DISTINCT dt FROM p ORDER BY dt DESC LIMIT 3)")
def recent(spark, d):
    return joins.recent_dates(src.supplier_months(spark, d).select("dt", "sym", "price"), "dt", 3)


@query("split_ratio", f"""WITH {PANEL}, t AS (SELECT dt, row_number() OVER (ORDER BY dt) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT dt FROM p))
SELECT dt, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.6) + floor(n * 0.2) THEN 'valid' ELSE 'test' END AS split FROM t""")
def split(spark, d):
    return joins.split_by_ratio(src.supplier_months(spark, d), "dt", 0.6, 0.2)


_FOLDS = [("1995-01", "1996-12", "1997-01", "1997-02"), ("1995-01", "1997-12", "1998-01", "1998-02"), ("1995-01", "1998-12", "1999-01", "1999-02")]


@query("expanding_folds", f"WITH {PANEL}, t AS (SELECT DISTINCT dt, strftime(dt, '%Y-%m') AS m FROM p) " + " UNION ALL ".join(
    f"SELECT {i} AS fold, CASE WHEN m BETWEEN '{s}' AND '{e}' THEN 'train' WHEN m = '{g}' THEN 'gap' ELSE 'valid' END AS role, dt FROM t WHERE m BETWEEN '{s}' AND '{e}' OR m IN ('{g}', '{v}')" for i, (s, e, g, v) in enumerate(_FOLDS, 1)))
def folds(spark, d):
    return joins.expanding_folds(src.supplier_months(spark, d), "dt", _FOLDS)


@query("dedupe_last", "SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY ALL")
def dedupe(spark, d):
    return joins.last_per_key(src.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts").drop("ts")


_NATIONS = [f"n{k}" for k in range(25)]


@query("wide_to_long", f"WITH {PANEL} SELECT CAST(dt AS DATE) AS date, 0 AS minute, 'n' || s_nationkey AS ticker, round(avg(price), 4) AS price FROM p JOIN supplier ON sym = s_suppkey GROUP BY ALL")
def wide(spark, d):
    s = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("sym"), F.concat(F.lit("n"), "s_nationkey").alias("s"))
    p = src.supplier_months(spark, d).join(s, "sym")
    return src.wide_to_long(p.groupBy("dt").pivot("s", _NATIONS).agg(rounded(F.avg("price"), 4)), "dt", "price")


# -- backtest --------------------------------------------------------------------------


def _pearson(a: str, b: str) -> str:
    return f"CASE WHEN stddev_samp({a}) > 1e-12 * sqrt(avg(power({a}, 2))) AND stddev_samp({b}) > 1e-12 * sqrt(avg(power({b}, 2))) THEN covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END"


_R2 = lambda c: f"2 * rank() OVER (PARTITION BY dt ORDER BY {c} NULLS LAST) + count(*) OVER (PARTITION BY dt, {c}) - 1"
BT = f"""{BASE}, r AS (SELECT dt, sym, f, ret, CASE WHEN f IS NOT NULL AND ret IS NOT NULL THEN f END AS fv, CASE WHEN f IS NOT NULL AND ret IS NOT NULL THEN ret END AS rv FROM b),
r2 AS (SELECT *, CASE WHEN fv IS NOT NULL THEN {_R2('fv')} END AS rf, CASE WHEN rv IS NOT NULL THEN {_R2('rv')} END AS rr, {_R2('f')} AS k2, count(f) OVER (PARTITION BY dt) AS nf FROM r),
r3 AS (SELECT *, CASE WHEN f IS NOT NULL THEN least(10, greatest(1, (k2 * 10 + 2 * nf - 1) // (2 * nf)))::INT END AS decile FROM r2),
r4 AS (SELECT *, CASE WHEN ret IS NOT NULL THEN decile END AS d FROM r3),
r5 AS (SELECT *, row_number() OVER (PARTITION BY dt, d ORDER BY f DESC, sym) AS place, count(*) OVER (PARTITION BY dt, d) AS size FROM r4),
r6 AS (SELECT *, greatest(1, floor(size * 0.2)) AS pick FROM r5),
m AS (SELECT dt, count(fv) AS n_obs, {_pearson('fv', 'rv')} AS ic, {_pearson('rf', 'rr')} AS rankic,
 {", ".join(f"avg(ret) FILTER (d = {k}) AS d{k}" for k in range(1, 11))},
 {", ".join(f"(avg(ret) FILTER (d = {k} AND place <= pick) - avg(ret) FILTER (d = {k} AND place > size - pick)) / 2 AS i{k}" for k in range(1, 11))}
 FROM r6 GROUP BY dt HAVING count(f) > 0 AND count(ret) > 0),
t AS (SELECT dt, row_number() OVER (ORDER BY dt) AS t FROM m),
g AS (SELECT t, sym, CASE WHEN decile = 10 THEN 0.5 ELSE -0.5 END / count(*) OVER (PARTITION BY t, decile) AS w FROM r3 JOIN t USING (dt) WHERE decile IN (1, 10)),
c AS (SELECT t, sum(abs(w)) / 20.0 AS turnover FROM (SELECT t, sym, sum(w) AS w FROM (SELECT t, sym, w FROM g UNION ALL SELECT t + 10, sym, -w FROM g) GROUP BY t, sym) GROUP BY t),
x AS (SELECT m.*, d10 AS long_ret, d1 AS short_ret, (d10 - d1) / 2 AS ls, CASE WHEN t.t > 10 THEN coalesce(c.turnover, 0) END AS turnover FROM m JOIN t USING (dt) LEFT JOIN c USING (t))"""


def _metrics(spark, d):
    return backtest.minute_metrics(base(spark, d))


@query("bt_ic_rankic", f"WITH {BT} SELECT dt, n_obs, round(ic, 6) AS ic, round(rankic, 6) AS rankic FROM x")
def bt_ic(spark, d):
    return out(_metrics(spark, d), "dt", "n_obs", ic=6, rankic=6)


@query("bt_deciles", f"WITH {BT} SELECT dt, " + ", ".join(f"round(d{k}, 7) AS decile_{k}_ret" for k in range(1, 11)) + " FROM x")
def bt_deciles(spark, d):
    return out(_metrics(spark, d), "dt", **{f"decile_{k}_ret": 7 for k in range(1, 11)})


@query("bt_long_short", f"WITH {BT} SELECT dt, round(long_ret, 7) AS long_ret, round(short_ret, 7) AS short_ret, round(ls, 7) AS long_short_ret FROM x")
def bt_ls(spark, d):
    return out(_metrics(spark, d), "dt", long_ret=7, short_ret=7, long_short_ret=7)


@query("bt_inner_ls", f"WITH {BT} SELECT dt, " + ", ".join(f"round(i{k}, 7) AS decile_{k}_inner_long_short" for k in range(1, 11)) + " FROM x")
def bt_inner(spark, d):
    return out(_metrics(spark, d), "dt", **{f"decile_{k}_inner_long_short": 7 for k in range(1, 11)})


@query("bt_turnover", f"WITH {BT} SELECT dt, round(turnover, 7) AS turnover FROM x")
def bt_turnover(spark, d):
    return out(_metrics(spark, d), "dt", turnover=7)


@query("bt_minute_metrics", f"WITH {BT} SELECT dt, n_obs, round(ic, 6) AS ic, round(rankic, 6) AS rankic, round(long_ret, 7) AS long_ret, round(short_ret, 7) AS short_ret, round(ls, 7) AS long_short_ret, round(turnover, 7) AS turnover FROM x")
def bt_minutes(spark, d):
    return out(_metrics(spark, d), "dt", "n_obs", ic=6, rankic=6, long_ret=7, short_ret=7, long_short_ret=7, turnover=7)


_SUM = """s AS (SELECT avg(ic) AS ic, stddev_samp(ic) AS ics, avg(rankic) AS ri, stddev_samp(rankic) AS ris, avg(long_ret) AS l, avg(short_ret) AS sh, avg(ls) AS ls, stddev_samp(ls) AS lss, avg(turnover) AS turnover, count(*) AS n,
 len(list_filter(generate_series(min(dt)::DATE, max(dt)::DATE, INTERVAL 1 DAY), lambda q: isodow(q) < 6)) AS days FROM x)"""


@query("bt_summary", f"""WITH {BT}, {_SUM}, y AS (SELECT *, n * 252.0 / days AS rate FROM s) SELECT round(ic, 6) AS "IC", round(ic / ics, 5) AS "ICIR", round(ri, 6) AS "RankIC", round(ri / ris, 5) AS "RankICIR",
 round(l * rate, 6) AS long_ret, round(sh * rate, 6) AS short_ret, round(ls * rate, 6) AS long_short_ret, round(lss * sqrt(rate), 6) AS volatility, round(ls * rate / (lss * sqrt(rate)), 5) AS sharpe, round(turnover, 7) AS turnover FROM y""")
def bt_summary(spark, d):
    return out(backtest.summarise(_metrics(spark, d), "dt"), IC=6, ICIR=5, RankIC=6, RankICIR=5, long_ret=6, short_ret=6, long_short_ret=6, volatility=6, sharpe=5, turnover=7)


@query("bt_ic_profile", f"WITH {BT} SELECT month(dt)::INT AS slot, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, count(ic)::BIGINT AS n, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 4) AS t FROM x GROUP BY 1")
def bt_profile(spark, d):
    return out(backtest.profile(_metrics(spark, d), F.month("dt")), "slot", "n", mean=6, std=6, t=4)


@query("bt_summary_upsert", "SELECT n_name AS factor, n_regionkey + 100 AS v FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, n_regionkey FROM nation WHERE n_regionkey <> 1")
def bt_upsert(spark, d):
    n = src.table(spark, d, "nation").select(F.col("n_name").alias("factor"), F.col("n_regionkey").alias("v"))
    return upsert(n, n.where("v = 1").withColumn("v", F.col("v") + 100), "factor")


@query("bt_business_days", "SELECT o_custkey, len(list_filter(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY), lambda q: isodow(q) < 6))::INT AS days FROM orders GROUP BY 1")
def bt_days(spark, d):
    return src.table(spark, d, "orders").groupBy("o_custkey").agg(backtest.business_days(F.min("o_orderdate"), F.max("o_orderdate")).alias("days"))


@query("bt_monotonicity", f"WITH {BT}, aa AS (SELECT " + ", ".join(f"avg(d{k}) AS a{k}" for k in range(1, 11)) + " FROM x) SELECT round((" + " + ".join(f"(a{k + 1} > a{k})::INT" for k in range(1, 10)) + ") / 9.0, 6) AS monotonicity FROM aa")
def bt_mono(spark, d):
    return out(backtest.monotonicity(_metrics(spark, d)), monotonicity=6)


# -- preparation and evaluation --------------------------------------------------------

_X = "OVER (PARTITION BY dt)"


@query("prep_winsor_z", f"""WITH {PANEL}, w AS (SELECT *, count(x) {_X} AS n_, quantile_cont(x, 0.05) {_X} AS lo, quantile_cont(x, 0.95) {_X} AS hi FROM p),
c AS (SELECT *, CASE WHEN n_ >= 5 THEN CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END ELSE x END AS v FROM w),
z AS (SELECT *, avg(v) {_X} AS m, stddev_samp(v) {_X} AS s FROM c)
SELECT dt, sym, round(CASE WHEN n_ >= 2 AND s >= 1e-12 THEN coalesce((v - m) / s, 0) WHEN x IS NOT NULL THEN 0 END, 5) AS x FROM z""")
def winsor(spark, d):
    return out(prep.winsor_zscore(src.supplier_months(spark, d).select("dt", "sym", "x"), M, ["x"], 0.05), "dt", "sym", x=5)


_W = "OVER (PARTITION BY month(dt))"
_WIN = f"""w AS (SELECT *, count(ret) {_W} AS n_, quantile_cont(ret, 0.05) {_W} AS lo, quantile_cont(ret, 0.95) {_W} AS hi FROM b),
c AS (SELECT dt, sym, ret, CASE WHEN n_ >= 5 THEN CASE WHEN ret < lo THEN lo WHEN ret > hi THEN hi ELSE ret END ELSE ret END AS v FROM w)"""
_ZZ = lambda v: f"round(coalesce(CASE WHEN count(v) {_X} < 5 OR stddev_samp({v}) {_X} IS NULL OR stddev_samp({v}) {_X} < 1e-8 THEN v ELSE ({v} - avg({v}) {_X}) / stddev_samp({v}) {_X} END, 0), 5)"


def _label(mode):
    def run(spark, d):
        b = base(spark, d).select("dt", "sym", "ret").withColumn("slot", F.month("dt"))
        return out(prep.training_label(b, M, "ret", mode, ["slot"], 0.05), "dt", "sym", label=5)

    return run


query("label_winsor", f"WITH {BASE}, {_WIN} SELECT dt, sym, round(v, 5) AS label FROM c")(_label("winsorize"))
query("label_zscore", f"WITH {BASE}, {_WIN} SELECT dt, sym, {_ZZ('v')} AS label FROM c")(_label("winsorize_zscore"))
query("label_rank_zscore", f"WITH {BASE}, {_WIN}, k AS (SELECT *, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY dt ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY dt, v) - 1) / 2.0 END AS r FROM c) SELECT dt, sym, {_ZZ('r')} AS label FROM k")(_label("winsorize_rank_zscore"))
query("label_rank", f"WITH {BASE}, k AS (SELECT *, CASE WHEN ret IS NOT NULL THEN rank() OVER (PARTITION BY month(dt) ORDER BY ret NULLS LAST) + (count(*) OVER (PARTITION BY month(dt), ret) - 1) / 2.0 END AS r FROM b) SELECT dt, sym, round(coalesce((r - avg(r) {_W}) / nullif(stddev_samp(r) {_W}, 0), 0), 5) AS label FROM k")(_label("rank"))


@query("relevance_bins", f"WITH {BASE} SELECT dt, sym, CASE WHEN ret IS NOT NULL THEN least(9, ((row_number() OVER (PARTITION BY dt ORDER BY ret NULLS LAST, sym) - 1) * 10) // greatest(count(ret) {_X}, 1))::INT END AS relevance FROM b")
def relevance(spark, d):
    return prep.relevance(base(spark, d), M, "ret").select("dt", "sym", "relevance")


@query("global_zscore", f"WITH {PANEL}, s AS (SELECT avg(x) AS m, stddev_pop(x) AS s, avg(qty) AS mq, stddev_pop(qty) AS sq FROM p) SELECT dt, sym, round(coalesce((x - m) / s, 0), 5) AS x, round((qty - mq) / sq, 5) AS qty FROM p, s")
def gz(spark, d):
    return out(prep.global_zscore(src.supplier_months(spark, d), ["x", "qty"]), "dt", "sym", x=5, qty=5)


@query("lag_features", f"WITH {PANEL}, l AS (SELECT dt, sym, price, lag(x, 2) OVER w AS x, lag(qty, 2) OVER w AS qty FROM p WINDOW w AS (PARTITION BY sym ORDER BY dt)) SELECT * FROM l WHERE x IS NOT NULL AND qty IS NOT NULL")
def lags(spark, d):
    return prep.lagged(src.supplier_months(spark, d).select("dt", "sym", "price", "x", "qty"), M, ["x", "qty"], 2)


EV = f"""{BASE}, e AS (SELECT *, f AS pred, ret AS y, count(*) {_X} AS n_ FROM b WHERE f IS NOT NULL),
e2 AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY pred, sym) AS k, CASE WHEN y IS NOT NULL THEN pred END AS pv FROM e WHERE n_ >= 10),
e3 AS (SELECT *, greatest(1, floor(n_ * 0.2)) AS leg, greatest(1, ceil((k - 1) * 10 / (n_ - 1)))::INT AS q, CASE WHEN y IS NOT NULL THEN {_R2('pv')} END AS rp, CASE WHEN y IS NOT NULL THEN {_R2('y')} END AS ry FROM e2),
ev AS (SELECT dt, count(*) AS n_obs, CASE WHEN count(y) >= 3 THEN {_pearson('pv', "y")} END AS ic, CASE WHEN count(y) >= 3 THEN {_pearson('rp', 'ry')} END AS rankic,
 avg(y) FILTER (k > n_ - leg) - avg(y) FILTER (k <= leg) AS ls, avg(y) AS bench, {", ".join(f"avg(y) FILTER (q = {k}) AS q{k}_ret" for k in range(1, 11))} FROM e3 GROUP BY dt)"""


def _ev(spark, d):
    return evaluate.cross_sections(base(spark, d).select("dt", "sym", F.col("f").alias("pred"), F.col("ret").alias("y")), M, "y", "pred")


@query("eval_cross_section", f"WITH {EV} SELECT dt, n_obs, round(ic, 6) AS ic, round(rankic, 6) AS rankic, round(ls, 7) AS long_short_ret, round(bench, 7) AS benchmark_ret FROM ev")
def ev_cross(spark, d):
    return out(_ev(spark, d), "dt", "n_obs", ic=6, rankic=6, long_short_ret=7, benchmark_ret=7)


@query("eval_quantiles", f"WITH {EV} " + " UNION ALL ".join(f"SELECT 'q{k}_ret' AS quantile, round(avg(q{k}_ret), 7) AS mean_ret, round(avg(q{k}_ret) * 9828, 3) AS annualized_ret FROM ev" for k in range(1, 11)))
def ev_quantiles(spark, d):
    return out(evaluate.quantile_table(_ev(spark, d), 10), "quantile", mean_ret=7, annualized_ret=3)


@query("eval_daily", f"""WITH {EV} SELECT year(dt)::INT AS date, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(rankic), 6) AS rankic_mean, round(stddev_samp(rankic), 6) AS rankic_std,
 round(avg(ls), 7) AS long_short_ret_mean, count(*)::BIGINT AS n_minutes, round(avg(ic) / stddev_samp(ic), 5) AS icir, round(avg(rankic) / stddev_samp(rankic), 5) AS rankicir FROM ev GROUP BY 1""")
def ev_daily(spark, d):
    return out(evaluate.daily(_ev(spark, d), F.year("dt")), "date", "n_minutes", ic_mean=6, ic_std=6, rankic_mean=6, rankic_std=6, long_short_ret_mean=7, icir=5, rankicir=5)


@query("eval_regression", f"WITH {PANEL}, e AS (SELECT price AS y, x * 0.9 + qty AS p FROM p WHERE x IS NOT NULL) SELECT round(avg((y-p)*(y-p)), 0) AS mse, round(sqrt(avg((y-p)*(y-p))), 3) AS rmse, round(avg(abs(y-p)), 4) AS mae, round(1 - avg((y-p)*(y-p)) / var_pop(y), 6) AS r2, round(avg((sign(y) = sign(p))::INT), 6) AS hit_rate, count(*)::BIGINT AS n FROM e")
def ev_reg(spark, d):
    p = src.supplier_months(spark, d).select(F.col("price").alias("y"), (F.col("x") * 0.9 + F.col("qty")).alias("p"))
    return out(evaluate.regression(p, "y", "p"), "n", mse=0, rmse=3, mae=4, r2=6, hit_rate=6)


@query("compare_panels", f"""WITH {PANEL}, a1 AS (SELECT dt, sym, x AS v FROM p WHERE sym <> 3), b1 AS (SELECT dt, sym, CASE WHEN sym % 5 = 0 THEN price + 1 ELSE price END AS v FROM p WHERE sym <> 4),
j AS (SELECT a1.sym AS ia, b1.sym AS ib, a1.v AS a, b1.v AS b FROM a1 FULL JOIN b1 USING (dt, sym)), k AS (SELECT *, ia IS NOT NULL AND ib IS NOT NULL AS both_ FROM j)
SELECT round(least(count(ia), count(ib)) / greatest(count(ia), count(ib)), 6) AS row_ratio, round(count(*) FILTER (both_) / count(*), 6) AS key_jaccard, count(*) FILTER (both_ AND (a IS NULL) <> (b IS NULL))::BIGINT AS missing_differ,
 round(count(*) FILTER (both_ AND (a IS NOT DISTINCT FROM b OR abs(a - b) <= 1e-6)) / count(*) FILTER (both_), 6) AS equal_share, count(*) FILTER (both_ AND a IS DISTINCT FROM b)::BIGINT AS differing, round(max(abs(a - b)) FILTER (both_), 4) AS max_gap FROM k""")
def compare(spark, d):
    p = src.supplier_months(spark, d)
    b = p.where("sym <> 4").select("dt", "sym", F.when(F.col("sym") % 5 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("v"))
    return out(evaluate.compare(p.where("sym <> 3").select("dt", "sym", F.col("x").alias("v")), b, ["dt", "sym"], "v"), "missing_differ", "differing", row_ratio=6, key_jaccard=6, equal_share=6, max_gap=4)


@query("monthly_ic", f"WITH {BT}, y AS (SELECT year(dt)::INT AS y, month(dt)::INT AS m, avg(ic) AS ic FROM x GROUP BY ALL) SELECT y, m, round(ic, 6) AS ic, round(sum(ic) OVER (ORDER BY y, m), 5) AS cumulative FROM y")
def monthly(spark, d):
    g = _metrics(spark, d).groupBy(F.year("dt").alias("y"), F.month("dt").alias("m")).agg(F.avg("ic").alias("ic"))
    return out(g.withColumn("cumulative", F.sum("ic").over(Window.orderBy("y", "m"))), "y", "m", ic=6, cumulative=5)


@query("coverage_bottleneck", f"WITH {BASE}, c AS (SELECT 'x' AS factor, max(dt) FILTER (x IS NOT NULL) AS last_date FROM b UNION ALL SELECT 'ret', max(dt) FILTER (ret IS NOT NULL) FROM b UNION ALL SELECT 'qty', max(dt) FROM b) SELECT factor, last_date, last_date = min(last_date) OVER () AS bottleneck FROM c")
def cover(spark, d):
    return evaluate.coverage(base(spark, d), "dt", ["x", "ret", "qty"])


@query("best_by_metric", "SELECT o_custkey, arg_max(o_orderkey, abs(o_totalprice - 150000)) AS o_orderkey FROM orders GROUP BY 1")
def best(spark, d):
    return evaluate.best_by(src.table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") - 150000).alias("m")), ["o_custkey"], "m").select("o_custkey", "o_orderkey")


# -- models ----------------------------------------------------------------------------

_FEATURES = ["qty", "vol", "n"]


def _xy(spark, d):
    return src.supplier_months(spark, d).select("dt", "sym", *[F.col(c).cast("double").alias(c) for c in _FEATURES], F.col("x").alias("y"))


def _parts(spark, d):
    p = _xy(spark, d)
    return p.where(F.year("dt") < 1999), p.where(F.year("dt") >= 1999)


# Three features have a closed form by Cramer's rule.
_MOMENTS = "count(*) AS c, avg(x) AS my, avg(qty) AS m1, avg(vol) AS m2, avg(n) AS m3, " + ", ".join(
    f"covar_pop({a}, {b}) * count(*) AS {k}" for k, a, b in (("s11", "qty", "qty"), ("s12", "qty", "vol"), ("s13", "qty", "n"), ("s22", "vol", "vol"), ("s23", "vol", "n"), ("s33", "n", "n"), ("b1", "x", "qty"), ("b2", "x", "vol"), ("b3", "x", "n"))
)


def _solved(rows: str, alphas: str) -> str:
    """CTEs up to w: alpha, w1, w2, w3 and the intercept b0 of the ridge on ``rows``."""
    return f"""mo AS (SELECT {_MOMENTS} FROM p WHERE x IS NOT NULL AND {rows}), al AS (SELECT unnest([{alphas}])::DOUBLE AS alpha),
an AS (SELECT alpha, s11 + alpha AS a11, s12 AS a12, s13 AS a13, s22 + alpha AS a22, s23 AS a23, s33 + alpha AS a33, mo.* FROM mo, al),
de AS (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM an),
w0 AS (SELECT *, (b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3)) / det AS w1,
 (a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13)) / det AS w2,
 (a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13)) / det AS w3 FROM de),
w AS (SELECT alpha, w1, w2, w3, my - m1 * w1 - m2 * w2 - m3 * w3 AS b0 FROM w0)"""


@query("ridge_fit", f"WITH {PANEL}, {_solved('true', '10')} SELECT round(w1, 4) AS w_qty, round(w2, 4) AS w_vol, round(w3, 4) AS w_n, round(b0, 2) AS intercept FROM w")
def ridge_fit(spark, d):
    w, b = model.Moments.of(_xy(spark, d), _FEATURES, "y").ridge(10.0)
    row = spark.createDataFrame([(*map(float, w), float(b))], "w_qty double, w_vol double, w_n double, intercept double")
    return out(row, w_qty=4, w_vol=4, w_n=4, intercept=2)


@query("ridge_alpha_search", f"""WITH {PANEL}, {_solved("year(dt) < 1999", ", ".join(f"1e{k}" for k in range(-4, 4)))},
v AS (SELECT alpha, x, b0 + w1 * qty + w2 * vol + w3 * n AS pred FROM p, w WHERE year(dt) >= 1999 AND x IS NOT NULL),
k AS (SELECT alpha, rank() OVER (PARTITION BY alpha ORDER BY pred) + count(*) OVER (PARTITION BY alpha, pred) / 2.0 AS rp, rank() OVER (PARTITION BY alpha ORDER BY x) + count(*) OVER (PARTITION BY alpha, x) / 2.0 AS rx FROM v)
SELECT alpha, round(corr(rp, rx), 6) AS rank_ic FROM k GROUP BY alpha""")
def ridge_search(spark, d):
    return out(spark.createDataFrame(model.search(*_parts(spark, d), _FEATURES, "y"), "alpha double, rank_ic double"), "alpha", rank_ic=6)


@query("ridge_predict", f"WITH {PANEL}, {_solved('true', '10')} SELECT dt, sym, round(b0 + w1 * qty + w2 * vol + w3 * n, 2) AS pred FROM p, w")
def ridge_predict(spark, d):
    p = _xy(spark, d)
    return out(p.withColumn("pred", model.predict(_FEATURES, *model.Moments.of(p, _FEATURES, "y").ridge(10.0))), "dt", "sym", pred=2)


def wide_features(spark, d, n: int = 37):
    """Lineitems with ``n`` features, waves of four columns, and a label made of some of them."""
    line = src.table(spark, d, "lineitem")
    base_ = [F.col("l_quantity") / 50, F.col("l_extendedprice") / 1e5, F.col("l_discount") * 10, F.col("l_tax") * 10]
    f = [F.sin(base_[k % 4] * (1 + k // 4) + k) for k in range(n)]
    y = f[0] + 0.5 * f[5] - 0.25 * f[9] + (F.col("l_partkey") % 100) / 100.0
    return line.select("l_shipdate", *[x.alias(f"f{k}") for k, x in enumerate(f)], y.alias("y")), [f"f{k}" for k in range(n)]


@query("ridge_wide_search")
def ridge_wide(spark, d):
    rows, names = wide_features(spark, d)
    early = F.year("l_shipdate") < 1997
    return spark.createDataFrame([(a, round(s, 8)) for a, s in model.search(rows.where(early), rows.where(~early), names, "y")], "alpha double, rank_ic double")


@query("gbt_predict")
def gbt(spark, d):
    m, rows = model.boosted_trees(_xy(spark, d), _FEATURES, "y", rounds=5)
    return m.transform(rows).select("dt", "sym", "y", "pred")


@query("lag_decay", f"WITH {PANEL}, " + ", ".join(f"l{k} AS (SELECT price AS y, lag(x, {k}) OVER (PARTITION BY sym ORDER BY dt) AS v FROM p)" for k in range(3)) + " " + " UNION ALL ".join(f"SELECT {k} AS lag, round({_pearson('y', 'v')}, 5) AS corr FROM l{k} WHERE v IS NOT NULL AND y IS NOT NULL" for k in range(3)))
def lag_decay(spark, d):
    from functools import reduce

    from ..functions.windows import pearson

    p = src.supplier_months(spark, d).select("dt", "sym", "price", "x")
    return reduce(DataFrame.unionByName, [out(prep.lagged(p, M, ["x"], k).agg(pearson(F.col("price"), F.col("x")).alias("corr")).withColumn("lag", F.lit(k)), "lag", corr=5) for k in range(3)])


@query("calibration_bins", f"WITH {PANEL}, e AS (SELECT quantile_cont(qty, [{', '.join(str(k / 10) for k in range(1, 10))}]) AS e FROM p WHERE x IS NOT NULL), c AS (SELECT 1 + len(list_filter(e, lambda q: qty >= q))::INT AS bin, qty, x FROM p, e WHERE x IS NOT NULL) SELECT bin, round(avg(qty), 5) AS pred, round(avg(x), 3) AS outcome, count(*)::BIGINT AS n FROM c GROUP BY 1")
def calibration(spark, d):
    return out(evaluate.calibration(src.supplier_months(spark, d), "qty", "x"), "bin", "n", pred=5, outcome=3)


@query("ic_histogram", f"WITH {BT} SELECT CASE WHEN ic < -0.5 THEN 0 WHEN ic >= 0.5 THEN 11 ELSE 1 + floor((ic + 0.5) * 10) END::INT AS bin, count(*)::BIGINT AS n FROM x WHERE ic IS NOT NULL GROUP BY 1")
def ic_histogram(spark, d):
    return evaluate.histogram(_metrics(spark, d), "ic", -0.5, 0.5, 10)


@query("available_dates", f"{_A} INTERSECT {_E} INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 30")
def available(spark, d):
    return joins.available_dates([*_two(spark, d), src.table(spark, d, "lineitem").where("l_quantity > 30").select(F.to_date("l_shipdate").alias("date"))], "date")


@query("group_sizes", f"WITH {PANEL} SELECT dt, count(*)::BIGINT AS n FROM p GROUP BY dt")
def group_sizes(spark, d):
    return src.supplier_months(spark, d).groupBy("dt").agg(F.count("*").alias("n"))


@query("best_trajectories", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def best_trajectories(spark, d):
    return src.table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(5)


@query("nodes_dedupe", "SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY ALL")
def nodes_dedupe(spark, d):
    return knowledge.distinct_nodes(src.table(spark, d, "part"), "p_partkey", ["p_brand", "p_size"])


@query("user_factor", f"WITH {PANEL} SELECT dt, sym, round(qty - avg(qty) OVER (PARTITION BY dt), 5) AS v FROM p")
def user_factor(spark, d):
    code = lambda g: g.assign(v=g["qty"] - g["qty"].mean())[["dt", "sym", "v"]]
    return out(joins.per_group(src.supplier_months(spark, d).select("dt", "sym", "qty"), ["dt"], code, "dt timestamp_ntz, sym long, v double"), "dt", "sym", v=5)


# -- vectors, graphs, expressions --------------------------------------------------------


# The stated query set: every row whose id is divisible by 100, against all rows.
SIMILAR = "sim AS (SELECT a.vec_id AS source, b.vec_id AS target, b.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"


@query("cosine_topk", f"WITH {SIMILAR} SELECT source, target, round(similarity, 5) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target)::INT AS place FROM sim) WHERE place <= 10")
def cosine_topk(spark, d):
    v = src.table(spark, d, "embeddings")
    return out(knowledge.top_of_each(v.where("vec_id % 100 = 0"), v, 10), "source", "target", "place", similarity=5)


@query("cosine_matrix", f"WITH {SIMILAR} SELECT source, target, round(similarity, 5) AS similarity FROM sim")
def cosine_matrix(spark, d):
    v = src.table(spark, d, "embeddings")
    return out(knowledge.similarity_matrix(v.where("vec_id % 100 = 0"), v), "source", "target", similarity=5)


_EDGES = "e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def _edges(spark, d):
    c = src.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
    return c.unionByName(src.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")))


_HOP = lambda start, k: f"SELECT '{start}' AS node, 0 AS step UNION SELECT t.b, h.step + 1 FROM h JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) t ON h.node = t.a WHERE h.step < {k}"


@query("khop", f"WITH RECURSIVE {_EDGES}, h AS ({_HOP('r1', 2)}) SELECT node, min(step) AS step FROM h GROUP BY node")
def khop(spark, d):
    return knowledge.within_steps(_edges(spark, d), spark.createDataFrame([("r1",)], "node string"), 2)


@query("neighbour_intersection", f"WITH RECURSIVE {_EDGES}, h AS ({_HOP('n1', 2)}), g AS ({_HOP('n2', 2).replace('FROM h', 'FROM g').replace('h.', 'g.')}) SELECT DISTINCT node FROM h WHERE node IN (SELECT node FROM g)")
def neighbours(spark, d):
    e, start = _edges(spark, d), lambda x: spark.createDataFrame([(x,)], "node string")
    return knowledge.within_steps(e, start("n1"), 2).select("node").intersect(knowledge.within_steps(e, start("n2"), 2).select("node"))


@query("edge_dedupe", "SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey")
def edge_dedupe(spark, d):
    return knowledge.distinct_edges(src.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


@query("text_trunks", "SELECT item_id, k::INT AS k, substr(text, k * 40 + 1, 40) AS trunk FROM (SELECT item_id, text, unnest(range(0, (length(text) + 39) // 40)) AS k FROM benchmark)")
def text_trunks(spark, d):
    return src.table(spark, d, "benchmark").select("item_id", F.posexplode(knowledge.trunks(F.col("text"), 40)).alias("k", "trunk"))


ZOO = {
    "mom": "RANK(DELTA($price, 1) - DELTA($price, 1)) / (1e-8 + 1)", "band": "(($price - TS_MIN($price, 14)) / (TS_MAX($price, 14) - TS_MIN($price, 14) + 1e-8))",
    "sign": "(-1 * $qty) * SIGN(MEDIAN($price) - $price)", "corr": "RANK(TS_CORR($price, $qty, 10)) * SIGN(TS_MEAN($vol, 5))", "tern": "$qty > 25 && $vol > 3 ? -$price : 0.5 * $price",
}
#: Every part names an expression; the zoo's stand among them.
_CANDIDATES = "c AS (SELECT 'p' || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'TS_MEAN($price, ' || p_size || ') - $qty / ' || p_partkey WHEN 1 THEN '(-1 * DELTA($vol, ' || p_size || ')) * SIGN($qty - ' || p_partkey || ')' ELSE '$qty > ' || p_size || ' && $vol > 3 ? -$price : 0.5 * $price' END AS e FROM part UNION ALL VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in ZOO.items()) + ")"
_MEASURES = f"""{_CANDIDATES}, c1 AS (SELECT name, replace(e, ' ', '') AS s FROM c), c2 AS (SELECT *, regexp_replace(s, '(^|[(,*/+?:<>&|=-])-([0-9])', '\\1\\2', 'g') AS u FROM c1),
c3 AS (SELECT name, length(s)::INT AS symbol_length, len(regexp_extract_all(u, '[0-9]+(\\.[0-9]+)?(e-?[0-9]+)?'))::INT AS numbers, regexp_extract_all(u, '\\$[a-z]+') AS v, len(regexp_extract_all(u, '[A-Z_]+\\('))::INT AS calls,
 len(regexp_extract_all(regexp_replace(u, '[0-9]+(\\.[0-9]+)?(e-?[0-9]+)?', '', 'g'), '&&|[-+*/?<>]'))::INT AS ops FROM c2),
ms AS (SELECT name, symbol_length, (numbers + len(v) + calls + ops)::INT AS nodes, numbers, len(list_distinct(v))::INT AS unique_vars, len(v)::INT AS vars FROM c3)"""


def _candidates(spark, d):
    part = src.table(spark, d, "part")
    text = lambda *x: F.concat(*[F.lit(y) if y.startswith("~") is False else F.col(y[1:]).cast("string") for y in x])
    e = F.when(F.col("p_partkey") % 3 == 0, text("TS_MEAN($price, ", "~p_size", ") - $qty / ", "~p_partkey")).when(F.col("p_partkey") % 3 == 1, text("(-1 * DELTA($vol, ", "~p_size", ")) * SIGN($qty - ", "~p_partkey", ")"))
    e = e.otherwise(text("$qty > ", "~p_size", " && $vol > 3 ? -$price : 0.5 * $price"))
    return part.select(F.concat(F.lit("p"), "p_partkey").alias("name"), e.alias("expression")).unionByName(_zoo(spark))


def _zoo(spark):
    return spark.createDataFrame(list(ZOO.items()), "name string, expression string")


@query("expr_metrics", f"WITH {_MEASURES} SELECT * FROM ms")
def expr_metrics(spark, d):
    return ast.measured(_candidates(spark, d))


@query("expr_accepted", f"""WITH {_MEASURES}, r AS (SELECT name, concat_ws(',', CASE WHEN NOT numbers <= 0.25 * nodes THEN 'free_numbers' END, CASE WHEN NOT unique_vars <= 0.2 * nodes THEN 'unique_fields' END, CASE WHEN NOT symbol_length <= 40 THEN 'length' END, CASE WHEN NOT unique_vars <= 2 THEN 'fields' END) AS reasons FROM ms)
SELECT name, reasons, reasons = '' AS accepted FROM r""")
def expr_accepted(spark, d):
    m = ast.measured(_candidates(spark, d))
    limit = {"free_numbers": F.col("numbers") <= 0.25 * F.col("nodes"), "unique_fields": F.col("unique_vars") <= 0.2 * F.col("nodes"), "length": F.col("symbol_length") <= 40, "fields": F.col("unique_vars") <= 2}
    return evaluate.quality_gate(m, limit).select("name", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query("expr_duplicates")
def expr_duplicates(spark, d):
    return ast.match_zoo(_candidates(spark, d), _zoo(spark))


@query("factor_ids_md5", "SELECT p_partkey, substr(md5(p_name || '_' || p_type), 1, 16) AS id FROM part")
def factor_ids(spark, d):
    return src.table(spark, d, "part").select("p_partkey", factor_id("p_name", "p_type").alias("id"))


@query("stream_bars", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, round(arg_min(value, ts), 6) AS first, round(arg_max(value, ts), 6) AS last, round(max(value), 6) AS max, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_bars(spark, d):
    import uuid

    from ..sources.sinks import shared_folder
    from ..streaming.bars import bars_of_stream

    own = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # As a pattern, a table of one file and one of a folder are both a source of files.
    b = bars_of_stream(spark, f"{d}/[e]vents.parquet", src.table(spark, d, "events").schema, f"{own}/bars", f"{own}/checkpoint", "ts", "event_type", "value", "1 hour")
    return out(b, F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", first=6, last=6, max=6, min=6, mean=6, std=6)


__all__ = ["Axes", "ORACLES", "QUERIES", "div"]

"""Queries of the reports, stores, graphs and gates, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.sqltext import PANEL, rounded
from ..functions.windows import Axes
from ..plans.compiler import evaluate as compiled
from ..sources import panel as src
from ..sources.sinks import FactorLibrary, shared_folder, shared_table
from . import backtest, bars, evaluate, joins, knowledge, model, prep
from .queries import _A, _E, _FEATURES, _FOLDS, _R2, BASE, EV, M, SIMILAR, _parts, _pearson, _quotes, _two, _xy, base, out, query

# -- schemas, keys, dates --------------------------------------------------------------


@query("panel_schema", "SELECT DISTINCT event_type AS stock_code, date_trunc('minute', ts) AS datetime FROM events")
def panel_schema(spark, d):
    q = src.quotes(spark, d).withColumn("minute", bars.ns_minute(bars.tick_ns(F.col("time_m"))))
    return src.with_panel_keys(q).select("stock_code", "datetime").distinct()


@query("dedupe_last_values", "SELECT user_id, event_type, arg_max(v, (ts, event_id)) FILTER (v IS NOT NULL) AS v, arg_max(p, (ts, event_id)) FILTER (p IS NOT NULL) AS p FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN value END AS v, CASE WHEN event_id % 2 > 0 THEN props END AS p FROM events) GROUP BY ALL")
def dedupe_last_values(spark, d):
    e = src.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 2 > 0, F.col("props")).alias("p"))
    return joins.last_values(e, ["user_id", "event_type"], ["ts", "event_id"])


@query("minute_labels", "SELECT event_id, strftime(ts, '%H:%M') AS label, epoch_us(date_trunc('minute', ts)) % 86400000000 * 1000 AS start_ns, epoch_us(date_trunc('minute', ts)) % 86400000000 * 1000 + 60000000000 AS end_ns FROM events")
def minute_labels(spark, d):
    e = src.table(spark, d, "events").select("event_id", (F.hour("ts") * 100 + F.minute("ts")).cast("int").alias("m"))
    start, end = bars.minute_bounds(F.col("m"))
    return e.select("event_id", bars.minute_label(F.col("m")).alias("label"), start.alias("start_ns"), end.alias("end_ns"))


@query("union_dates", f"{_A} UNION {_E}")
def union_dates(spark, d):
    return joins.any_dates(list(_two(spark, d)), "date")


@query("paired_days", f"{_A} INTERSECT {_E}")
def paired_days(spark, d):
    return joins.paired_days(*_two(spark, d))


@query("list_days", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders")
def list_days(spark, d):
    return src.list_days(src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")))


@query("symbol_universe", "SELECT DISTINCT l_suppkey AS k, l_returnflag AS f FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_discount < 0.02")
def symbol_universe(spark, d):
    l = src.table(spark, d, "lineitem").withColumns({"k": F.col("l_suppkey"), "f": F.col("l_returnflag")})
    return joins.symbol_universe(l.where("l_quantity > 40"), l.where("l_discount < 0.02"), ["k", "f"])


@query("date_filter", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30' AND year(o_orderdate) IN (1995, 1996) AND o_orderstatus IN ('F', 'O')")
def date_filter(spark, d):
    o = src.table(spark, d, "orders")
    ranged = joins.on_dates(o, "o_orderdate", F.expr("timestamp_ntz'1995-01-01'"), F.expr("timestamp_ntz'1996-06-30'"))
    return joins.on_dates(ranged, "o_orderstatus", wanted=["F", "O"]).select("o_orderkey")


@query("first_days", f"WITH {PANEL} SELECT dt, sym, price FROM p WHERE dt IN (SELECT DISTINCT dt FROM p ORDER BY dt LIMIT 3)")
def first_days(spark, d):
    return joins.first_dates(src.supplier_months(spark, d).select("dt", "sym", "price"), "dt", 3)


@query("split_two_way", f"""WITH {PANEL}, t AS (SELECT dt, row_number() OVER (ORDER BY dt) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT dt FROM p))
SELECT dt, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'valid' END AS split FROM t""")
def split_two_way(spark, d):
    return joins.split_two_way(src.supplier_months(spark, d), "dt", 0.8)


@query("distinct_days", "SELECT event_type, count(DISTINCT CAST(ts AS DATE))::BIGINT AS days FROM events GROUP BY 1")
def distinct_days(spark, d):
    return src.table(spark, d, "events").groupBy("event_type").agg(F.count_distinct(F.to_date("ts")).alias("days"))


# -- reports -----------------------------------------------------------------------------


@query("compare_correlation", f"""WITH {PANEL}, j AS (SELECT dt, x AS a, price + 40 * (sym % 5) AS b FROM p WHERE x IS NOT NULL),
k AS (SELECT dt, a, b, {_R2('a')} AS ra, {_R2('b')} AS rb FROM j), t AS (SELECT dt, {_pearson('a', 'b')} AS ic, {_pearson('ra', 'rb')} AS rankic FROM k GROUP BY dt)
SELECT round(avg(ic), 6) AS ic, round(avg(rankic), 6) AS rankic, 0::BIGINT AS inf_a, (SELECT count(*) FROM p WHERE sym = 3)::BIGINT AS inf_b, avg(ic) > 0.99 AND avg(rankic) > 0.99 AS agrees FROM t""".replace("WHERE x IS NOT NULL),", "WHERE x IS NOT NULL AND sym <> 3),"))
def compare_correlation(spark, d):
    p = src.supplier_months(spark, d)
    b = p.select("dt", "sym", F.when(F.col("sym") == 3, F.lit(float("inf"))).otherwise(F.col("price") + 40 * (F.col("sym") % 5)).alias("v"))
    return out(evaluate.agreement(p.select("dt", "sym", F.col("x").alias("v")), b, ["dt", "sym"], ["dt"], "v"), "inf_a", "inf_b", "agrees", ic=6, rankic=6)


_STATUS = lambda s: f"SELECT count(*)::DOUBLE AS n, avg(o_totalprice) AS mean, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = '{s}'"


@query("current_vs_best", f"""WITH c AS (UNPIVOT ({_STATUS('F')}) ON n, mean, top INTO NAME metric VALUE current), b AS (UNPIVOT ({_STATUS('O')}) ON n, mean, top INTO NAME metric VALUE best)
SELECT metric, round(current, 3) AS current, round(best, 3) AS best, CASE WHEN current > best THEN 'current' WHEN current < best THEN 'best' ELSE 'equal' END AS bigger FROM c JOIN b USING (metric)""")
def current_vs_best(spark, d):
    of = lambda s: src.table(spark, d, "orders").where(F.col("o_orderstatus") == s).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("top"))
    return out(evaluate.versus(of("F"), of("O"), ["n", "mean", "top"]), "metric", "bigger", current=3, best=3)


@query("split_report", f"""WITH {EV}, s AS (SELECT *, CASE WHEN year(dt) < 1996 THEN 'train' WHEN year(dt) < 1997 THEN 'valid' ELSE 'test' END AS split FROM ev),
g AS (SELECT split, avg(ic) AS ic, avg(ic) / stddev_samp(ic) AS icir, avg(rankic) AS rankic, avg(rankic) / stddev_samp(rankic) AS rankicir, avg(ls) AS ls, avg(ls) / stddev_samp(ls) * sqrt(9828) AS sharpe, count(*) AS n_times FROM s GROUP BY 1),
r AS (SELECT CASE WHEN year(dt) < 1996 THEN 'train' WHEN year(dt) < 1997 THEN 'valid' ELSE 'test' END AS split, ret AS y, f / 1e6 AS p FROM b WHERE ret IS NOT NULL AND f IS NOT NULL),
h AS (SELECT split, sqrt(avg((y-p)*(y-p))) AS rmse, avg(abs(y-p)) AS mae, 1 - avg((y-p)*(y-p)) / var_pop(y) AS r2, avg((sign(y) = sign(p))::INT) AS hit_rate, count(*)::BIGINT AS n FROM r GROUP BY 1)
SELECT split, n, n_times::BIGINT AS n_times, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 5) AS r2, round(hit_rate, 6) AS hit_rate, round(ic, 6) AS ic, round(icir, 5) AS icir, round(rankic, 6) AS rankic, round(rankicir, 5) AS rankicir, round(ls, 7) AS long_short_ret, round(sharpe, 3) AS sharpe FROM h LEFT JOIN g USING (split)""")
def split_report(spark, d):
    b = base(spark, d).select("dt", "sym", (F.col("f") / 1e6).alias("pred"), F.col("ret").alias("y"))
    b = b.withColumn("split", F.when(F.year("dt") < 1996, "train").when(F.year("dt") < 1997, "valid").otherwise("test"))
    return out(evaluate.split_report(b, "split", M, "y", "pred"), "split", "n", "n_times", rmse=6, mae=6, r2=5, hit_rate=6, ic=6, icir=5, rankic=6, rankicir=5, long_short_ret=7, sharpe=3)


_POOL = "SELECT o_orderstatus AS phase, o_orderpriority AS direction, (o_custkey % 9)::INT AS round_idx FROM orders"


@query("pool_statistics", f"WITH o AS ({_POOL}) SELECT 'total' AS what, '' AS value, count(*)::BIGINT AS n FROM o UNION ALL SELECT 'last round', '', max(round_idx)::BIGINT FROM o UNION ALL SELECT 'phase', phase, count(*)::BIGINT FROM o GROUP BY phase UNION ALL SELECT 'direction', direction, count(*)::BIGINT FROM o GROUP BY direction")
def pool(spark, d):
    o = src.table(spark, d, "orders").select(F.col("o_orderstatus").alias("phase"), F.col("o_orderpriority").alias("direction"), (F.col("o_custkey") % 9).cast("int").alias("round_idx"))
    return evaluate.pool_statistics(o, ["phase", "direction"], "round_idx")


@query("report_order", "SELECT *, coalesce(nullif(list_position(['P', 'F'], phase), 0), 3)::INT AS phase_order FROM (SELECT (o_custkey % 9)::INT AS round_idx, o_orderstatus AS phase, o_orderpriority AS direction, count(*)::BIGINT AS n FROM orders GROUP BY ALL) ORDER BY round_idx, phase_order, direction")
def report_order(spark, d):
    o = src.table(spark, d, "orders").groupBy((F.col("o_custkey") % 9).cast("int").alias("round_idx"), F.col("o_orderstatus").alias("phase"), F.col("o_orderpriority").alias("direction")).agg(F.count("*").alias("n"))
    return evaluate.report_order(o, ["round_idx", "phase", "direction"], ["P", "F"], "phase")


@query("quality_gate", "SELECT o_orderkey, concat_ws(',', CASE WHEN NOT o_totalprice < 200000 THEN 'price' END, CASE WHEN NOT o_orderstatus <> 'P' THEN 'status' END, CASE WHEN NOT year(o_orderdate) >= 1994 THEN 'date' END) AS reasons, o_totalprice < 200000 AND o_orderstatus <> 'P' AND year(o_orderdate) >= 1994 AS accepted FROM orders")
def gate(spark, d):
    o = evaluate.quality_gate(src.table(spark, d, "orders"), {"price": F.col("o_totalprice") < 200000, "status": F.col("o_orderstatus") != "P", "date": F.year("o_orderdate") >= 1994})
    return o.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"), "accepted")


# -- factors from expression to store ------------------------------------------------------


@query("factor_table", f"WITH {PANEL} SELECT dt, sym, round(avg(price) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / qty, 5) AS factor FROM p")
def factor_table(spark, d):
    p, text = src.supplier_months(spark, d), "TS_MEAN($price, 5) / $qty"
    catalog = src.FeatureCatalog(p.drop("qty"), {"qty": p.select("dt", "sym", "qty")}, ("dt", "sym"))
    stored = shared_table(compiled(catalog.for_expression(text), {"factor": text}, M), "factor")
    return out(stored, "dt", "sym", factor=5)


@query("library_status", "WITH w AS (SELECT DISTINCT p_brand AS name, p_type AS expression FROM part), l AS (SELECT DISTINCT p_brand AS name, p_type AS expression FROM part WHERE p_size > 25) SELECT name, expression, substr(md5(name || '_' || expression), 1, 16) AS id, (name, expression) IN (SELECT (name, expression) FROM l) AS cached FROM w")
def library_status(spark, d):
    part = src.table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("expression"), "p_size")
    library = FactorLibrary(spark, f"{shared_folder(spark)}/library-{uuid.uuid4().hex}")
    for low, high in ((26, 40), (35, 10**6)):  # the second call replaces what the first one has
        library.add(part.where(F.col("p_size").between(low, high)).select("name", "expression", F.lit("there").alias("path")).distinct())
    return library.status(part.select("name", "expression").distinct()).select("name", "expression", "id", "cached")


# -- models --------------------------------------------------------------------------------


@query("trees_cross_validated")
def trees(spark, d):
    """Rounds of each fold; the model of all rows is what the last column counts."""
    rows = prep.winsorize_by(_xy(spark, d).withColumn("slot", F.month("dt")), ["slot"], "y", 0.05, "label")
    folds = joins.expanding_folds(rows, "dt", _FOLDS)
    found, fitted = model.cross_validated_trees(rows, folds, "dt", _FEATURES, "y", "label", rounds=4, patience=2)
    return spark.createDataFrame([(k, n, fitted.getNumTrees) for k, n in found], "fold int, rounds int, trees int")


@query("ridge_tuned", None)
def ridge_tuned(spark, d):
    train, valid = _parts(spark, d)
    moments = model.Moments.of(train, _FEATURES, "y")
    pred = lambda s: valid.withColumn("pred", model.predict(_FEATURES, *moments.ridge(s["alpha"])))
    found = model.tune(train, valid, _FEATURES, "y", M, [{"alpha": a} for a in (0.1, 10.0, 1000.0)], pred)
    return spark.createDataFrame([(s["alpha"], round(r, 8)) for s, r in found], "alpha double, rankic double")


@query("lag_report")
def lag_report(spark, d):
    return spark.createDataFrame([(k, float(r), None if q is None else float(q)) for k, r, q in model.lag_report(_xy(spark, d), M, _FEATURES, "y", [0, 1, 3])], "lag int, rankic double, ratio double")


# -- graphs --------------------------------------------------------------------------------

_LINKS = "e AS (SELECT vec_id AS a, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS b FROM embeddings), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def _links(spark, d):
    v = src.table(spark, d, "embeddings")
    return v, v.select(F.col("vec_id").alias("a"), ((F.col("vec_id") * 7 + 3) % v.count()).alias("b"))


@query("graph_query_by_content", f"""WITH {SIMILAR}, {_LINKS}, h AS (SELECT source, target AS node, similarity AS s FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) AS k FROM sim) WHERE k <= 3),
f AS (SELECT source, node, s, 0 AS step FROM h UNION ALL SELECT source, both_.b, s, 1 FROM h JOIN both_ ON node = both_.a),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY step, s DESC) AS k FROM f) WHERE k = 1),
r AS (SELECT source, node, label, step, row_number() OVER (PARTITION BY source ORDER BY step, s DESC, node) AS place FROM g JOIN embeddings ON node = vec_id WHERE label IN (0, 1, 2, 3))
SELECT source, node, label, step::INT AS step, place::INT AS place FROM r WHERE place <= 3""")
def content(spark, d):
    v, links = _links(spark, d)
    return knowledge.query_by_content(v, v.where("vec_id % 100 = 0"), links, 3, 1, [0, 1, 2, 3])


@query("graph_labelled_steps", f"WITH {_LINKS}, h AS (SELECT 0 AS node, 0 AS step UNION SELECT b, 1 FROM both_ WHERE a = 0 UNION SELECT y.b, 2 FROM both_ x JOIN both_ y ON x.b = y.a WHERE x.a = 0) SELECT node::BIGINT AS node, min(step)::INT AS step, label FROM h JOIN embeddings ON node = vec_id WHERE label IN (0, 1, 2, 3) GROUP BY node, label")
def labelled(spark, d):
    v, links = _links(spark, d)
    return knowledge.labelled_steps(links, v.select(F.col("vec_id").alias("node"), "label"), spark.createDataFrame([(0,)], "node long"), 2, [0, 1, 2, 3])


@query("similar_solved_cases", f"WITH {SIMILAR}, s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target)::INT AS place FROM sim WHERE label % 2 = 0) SELECT source, target, place, label AS solution, round(similarity, 5) AS similarity FROM s WHERE place <= 3 AND similarity >= 0.1")
def solved(spark, d):
    v = src.table(spark, d, "embeddings")
    known = v.where("label % 2 = 0").select("vec_id", F.col("label").alias("solution"))
    return out(knowledge.similar_errors(v, v.where("vec_id % 100 = 0"), known, 3, 0.1), "source", "target", "place", "solution", similarity=5)


__all__ = ["Axes", "BASE", "backtest", "rounded"]

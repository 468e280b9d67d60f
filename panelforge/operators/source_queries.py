"""Queries of readers, sinks, tickers and registered functions, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.registry import REGISTRY, corr_with, register
from ..functions.sqltext import PANEL
from ..plans.compiler import evaluate as compiled
from ..sources import panel as src
from ..sources import sinks
from . import model
from .queries import M, out, query


def _path(spark, name: str) -> str:
    return f"{sinks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "ticker_parts",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN c_mktsegment ELSE c_mktsegment || '.' || chr((65 + c_nationkey)::INT) END AS ticker,
c_mktsegment AS root, CASE WHEN c_custkey % 4 < 3 THEN '' ELSE chr((65 + c_nationkey)::INT) END AS suffix FROM customer""",
)
def ticker_parts(spark, d):
    kind = F.col("c_custkey") % 4
    suffix = F.when(kind == 1, "None").when(kind == 2, " ").when(kind == 3, F.char((65 + F.col("c_nationkey")).cast("int")))
    c = src.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("sym_root"), suffix.alias("sym_suffix"))
    root, tail = src.split_ticker(F.col("ticker"))
    return c.select("c_custkey", src.ticker().alias("ticker")).select("c_custkey", "ticker", root.alias("root"), tail.alias("suffix"))


@query("daily_shards", f"WITH {PANEL} SELECT dt::DATE AS date, sym::VARCHAR AS sym_root, CASE WHEN year(dt) = 1995 THEN -qty ELSE qty END AS qty FROM p")
def daily_shards(spark, d):
    """A store of a folder a day; writing the days of one year anew leaves the others."""
    path = sinks.assert_safe(_path(spark, "days"), (d,))
    p = src.supplier_months(spark, d).select(F.to_date("dt").alias("date"), F.col("sym").cast("string").alias("sym_root"), "qty", "vol")
    sinks.write_days(p, path, (d,))
    sinks.write_days(p.where(F.year("date") == 1995).withColumn("qty", -F.col("qty")), path, (d,))
    return src.read_long(spark, path, ["qty"])


@query("rounded_metrics", "SELECT l_returnflag || l_linestatus AS factor, ROUND(avg(l_discount), 4) AS ic, ROUND(avg(l_extendedprice) / 1e5, 6) AS ret, count(*)::INT AS n FROM lineitem GROUP BY 1")
def rounded_metrics(spark, d):
    """Metrics as CSV, IC-like ones to 4 digits and returns to 6, read back as a research summary."""
    m = src.table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("factor"))
    m = m.agg(F.avg("l_discount").alias("ic"), (F.avg("l_extendedprice") / 1e5).alias("ret"), F.count("*").alias("n"))
    path = _path(spark, "metrics")
    sinks.write_metrics(m, path, {"ic": 4, "ret": 6}, (d,))
    return src.read_summary(spark, path)


@query(
    "universe_file",
    """SELECT n_name AS sym_root, CASE WHEN n_nationkey % 3 = 1 THEN 'A' ELSE '' END AS sym_suffix, DATE '1995-01-01' + n_nationkey::INT AS in_date,
CASE WHEN n_nationkey % 2 = 0 THEN DATE '1997-01-01' + n_nationkey::INT END AS out_date FROM nation""",
)
def universe_file(spark, d):
    """The membership document: dates with and without dashes, no suffix in three spellings."""
    n = F.col("n_nationkey").cast("int")
    u = src.table(spark, d, "nation").select(
        F.struct(
            F.col("n_name").alias("wrds_sym_root"), F.when(n % 3 == 1, "A").when(n % 3 == 2, "None").alias("wrds_sym_suffix"),
            F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), n), "yyyyMMdd").alias("in_date"),
            F.when(n % 2 == 0, F.date_format(F.date_add(F.lit("1997-01-01").cast("date"), n), "yyyy-MM-dd")).alias("out_date"),
        ).alias("u")
    )
    path = _path(spark, "universe")
    u.agg(F.collect_list("u").alias("universe")).write.json(path)
    return src.read_universe(spark, path)


@query("calendar_file", "SELECT DISTINCT o_orderdate::DATE AS date FROM orders")
def calendar_file(spark, d):
    path = _path(spark, "calendar")
    o = src.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date")).distinct()
    o.write.option("header", "true").csv(path)
    return src.read_calendar(spark, path)


@query("model_artefacts", f"WITH {PANEL} SELECT dt, sym, round(price * 0.001 - qty * 0.5 + 2.25, 5) AS pred FROM p")
def model_artefacts(spark, d):
    path = _path(spark, "model")
    sinks.write_model(spark, path, {"price": 0.001, "qty": -0.5}, {"alpha": "10", "intercept": "2.25"}, (d,))
    weights, meta = sinks.read_model(spark, path)
    names = sorted(weights)
    p = src.supplier_months(spark, d).withColumn("pred", model.predict(names, [weights[n] for n in names], float(meta["intercept"])))
    return out(p, "dt", "sym", pred=5)


@query("dsl_constants", f"WITH {PANEL} SELECT dt, sym, CASE WHEN qty > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS a, CASE WHEN qty > 25 THEN qty END AS b, round(qty * 100 + 0.5 - 0.02, 4) AS c, NULL::DOUBLE AS e FROM p")
def dsl_constants(spark, d):
    """TRUE, FALSE, NAN, NULL and the forms of numbers."""
    exprs = {"a": "WHERE($qty > 25, TRUE, FALSE)", "b": "$qty > 25 ? $qty : NAN", "c": "$qty * 1e2 + .5 - 2E-2", "e": "$qty + NULL"}
    e = compiled(src.supplier_months(spark, d), exprs, M).withColumn("e", F.col("e").cast("double"))
    return out(e, "dt", "sym", "a", "b", "e", c=4)


@query("user_function", f"WITH {PANEL} SELECT dt, sym, round(avg(abs(qty - 25)) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS a FROM p")
def user_function(spark, d):
    """A function of the user's own, inside one of the language's."""
    if "FAR_FROM" not in REGISTRY:
        register("FAR_FROM", "scalar")(lambda ax, x, p: F.abs(x - F.lit(float(p))))
    return out(compiled(src.supplier_months(spark, d), {"a": "TS_MEAN(FAR_FROM($qty, 25), 3)"}, M), "dt", "sym", a=6)


@query(
    "ts_corr_weights",
    f"""WITH {PANEL}, s AS (SELECT dt, sym, x, row_number() OVER (PARTITION BY sym ORDER BY dt) AS k FROM p),
j AS (SELECT a.dt, a.sym, b.x AS v, CASE WHEN b.x IS NOT NULL THEN 8.0::DOUBLE / pow(2, a.k - b.k) END AS w FROM s a JOIN s b ON a.sym = b.sym AND b.k BETWEEN a.k - 3 AND a.k)
SELECT dt, sym, round(CASE WHEN count(v) >= 2 THEN coalesce(covar_pop(v, w) / nullif(stddev_pop(v) * stddev_pop(w), 0), 0) END, 6) AS c FROM j GROUP BY dt, sym""",
)
def ts_corr_weights(spark, d):
    p = src.supplier_months(spark, d)
    return out(p.withColumn("c", corr_with(M, F.col("x"), [1.0, 2.0, 4.0, 8.0])), "dt", "sym", c=6)

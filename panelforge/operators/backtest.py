"""Single-factor evaluation per cross-section, and its summary.

Everything stays long: one window partition per time serves ranks, deciles and picks,
one aggregate per time gives the metrics.  Only turnover compares two times: rows of the
outer deciles meet those ``hold`` times earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import Axes, div, pearson

PER_YEAR = 252


def double_rank(x: Column, part: list[str]) -> Column:
    """Twice the average rank among the present values of a partition: a whole number."""
    return 2 * F.rank().over(Window.partitionBy(*part).orderBy(x.asc_nulls_last())) + F.count(F.lit(1)).over(Window.partitionBy(*part, x)) - 1


def ranked(df: DataFrame, axes: Axes, factor: str, ret: str, groups: int = 10) -> DataFrame:
    """Adds both sides' ranks where both are present (_rf, _rr), the decile by the factor alone, and the decile where a label is there."""
    part = [c for c in axes.keys if c != axes.symbol]
    f, r = F.col(factor), F.col(ret)
    ok = f.isNotNull() & r.isNotNull()
    out = df.withColumns({"_f": F.when(ok, f), "_r": F.when(ok, r)})
    n = F.count(f).over(Window.partitionBy(*part))
    decile = F.expr(f"CASE WHEN `{factor}` IS NOT NULL THEN least({groups}, greatest(1, (_r2 * {groups} + 2 * _n - 1) div (2 * _n))) END").cast("int")
    out = out.withColumns({"_r2": double_rank(f, part), "_n": n, "_rf": F.when(ok, double_rank(F.col("_f"), part)), "_rr": F.when(ok, double_rank(F.col("_r"), part))})
    return out.withColumn("decile", decile).withColumn("_d", F.when(r.isNotNull(), F.col("decile")))


def minute_metrics(df: DataFrame, axes: Axes = Axes(), factor: str = "f", ret: str = "ret", groups: int = 10, q: float = 0.2, hold: int = 10) -> DataFrame:
    part = [c for c in axes.keys if c != axes.symbol]
    r = ranked(df, axes, factor, ret, groups)
    inside = Window.partitionBy(*part, "_d")
    place = F.row_number().over(inside.orderBy(F.col(factor).desc(), axes.symbol))
    size = F.count(F.lit(1)).over(inside)
    pick = F.greatest(F.lit(1), F.floor(F.col("_size") * F.lit(q)).cast("int"))
    r = r.withColumns({"_place": place, "_size": size}).withColumn("_pick", pick)
    value = F.when(F.col("_d").isNotNull(), F.col(ret))
    mean = lambda test: F.avg(F.when(test, value))
    deciles = [mean(F.col("_d") == k).alias(f"decile_{k}_ret") for k in range(1, groups + 1)]
    inner = [
        ((mean((F.col("_d") == k) & (F.col("_place") <= F.col("_pick"))) - mean((F.col("_d") == k) & (F.col("_place") > F.col("_size") - F.col("_pick")))) / 2).alias(f"decile_{k}_inner_long_short")
        for k in range(1, groups + 1)
    ]
    # A time with no factor at all or no label at all is no cross-section.
    out = r.groupBy(*part).agg(
        F.count("_f").alias("n_obs"), pearson(F.col("_f"), F.col("_r")).alias("ic"), pearson(F.col("_rf").cast("double"), F.col("_rr").cast("double")).alias("rankic"),
        *deciles, *inner, F.count(factor).alias("_nf"), F.count(ret).alias("_nr"),
    ).where("_nf > 0 and _nr > 0").drop("_nf", "_nr")
    out = out.withColumns({"long_ret": F.col(f"decile_{groups}_ret"), "short_ret": F.col("decile_1_ret"), "long_short_ret": (F.col(f"decile_{groups}_ret") - F.col("decile_1_ret")) / 2})
    out = out.join(turnover(r, axes, out.select(*part), groups, hold), part, "left")
    names = ["n_obs", "ic", "rankic", "long_ret", "short_ret", "long_short_ret", "turnover", *[f"decile_{k}_ret" for k in range(1, groups + 1)], *[f"decile_{k}_inner_long_short" for k in range(1, groups + 1)]]
    return out.select(*part, *names)


def turnover(deciled: DataFrame, axes: Axes, times: DataFrame, groups: int, hold: int) -> DataFrame:
    """Half the weight that changes hands against the book of ``hold`` times ago, over ``hold``.

    Weights are half of each leg spread evenly; a symbol that is absent weighs 0; the
    first ``hold`` times of a session have none.
    """
    part = [c for c in axes.keys if c != axes.symbol]
    session = [axes.session] if axes.session else []
    number = times.withColumn("_t", F.row_number().over(Window.partitionBy(*(session or [F.lit(0)])).orderBy(axes.time)))
    legs = deciled.where(F.col("decile").isin(1, groups))
    weight = F.when(F.col("decile") == groups, 0.5).otherwise(-0.5) / F.count(F.lit(1)).over(Window.partitionBy(*part, "decile"))
    legs = legs.select(*part, axes.symbol, weight.alias("_w")).join(number, part)
    moved = legs.select(*session, axes.symbol, "_t", "_w").unionByName(legs.select(*session, axes.symbol, (F.col("_t") + hold).alias("_t"), (-F.col("_w")).alias("_w")))
    change = moved.groupBy(*session, axes.symbol, "_t").agg(F.sum("_w").alias("_w")).groupBy(*session, "_t").agg((F.sum(F.abs("_w")) / (2.0 * hold)).alias("turnover"))
    return number.where(F.col("_t") > hold).join(change, [*session, "_t"], "left").select(*part, F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def business_days(first: Column, last: Column) -> Column:
    """Mondays to Fridays between two dates, both counted."""
    return F.size(F.filter(F.sequence(first.cast("date"), last.cast("date")), lambda d: F.weekday(d) < 5))


def summarise(metrics: DataFrame, time: str, by: list[str] | None = None, per_year: int = PER_YEAR) -> DataFrame:
    """One row (a factor): means, ratios to deviations, and returns at the calendar span's rate."""
    a = metrics.groupBy(*(by or [])).agg(
        F.avg("ic").alias("IC"), F.stddev_samp("ic").alias("_ics"), F.avg("rankic").alias("RankIC"), F.stddev_samp("rankic").alias("_ris"), F.avg("long_ret").alias("_l"), F.avg("short_ret").alias("_s"),
        F.avg("long_short_ret").alias("_ls"), F.stddev_samp("long_short_ret").alias("_lss"), F.avg("turnover").alias("turnover"), F.count("*").alias("_n"), business_days(F.min(time), F.max(time)).alias("_days"),
    )
    a = a.withColumn("_rate", F.when(F.col("_days") >= 1, div(F.col("_n") * per_year, F.col("_days"))).otherwise(F.col("_n") * F.lit(float(per_year))))
    a = a.withColumns({"long_ret": F.col("_l") * F.col("_rate"), "short_ret": F.col("_s") * F.col("_rate"), "long_short_ret": F.col("_ls") * F.col("_rate"), "volatility": F.col("_lss") * F.sqrt("_rate")})
    return a.select(*(by or []), "IC", div(F.col("IC"), F.col("_ics")).alias("ICIR"), "RankIC", div(F.col("RankIC"), F.col("_ris")).alias("RankICIR"), "long_ret", "short_ret", "long_short_ret", "volatility", div(F.col("long_short_ret"), F.col("volatility")).alias("sharpe"), "turnover")


def profile(metrics: DataFrame, slot: Column, value: str = "ic") -> DataFrame:
    """Mean, deviation, count and t of a metric by time slot."""
    g = metrics.groupBy(slot.alias("slot")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    return g.withColumn("t", div(F.col("mean"), F.col("std") / F.sqrt("n")))


def monotonicity(metrics: DataFrame, groups: int = 10) -> DataFrame:
    """Share of neighbouring deciles whose mean return rises."""
    m = metrics.agg(F.array(*[F.avg(f"decile_{k}_ret") for k in range(1, groups + 1)]).alias("d"))
    pairs = F.filter(F.arrays_zip(F.slice("d", 1, groups - 1).alias("a"), F.slice("d", 2, groups - 1).alias("b")), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    return m.select(div(F.size(F.filter(pairs, lambda p: p["b"] > p["a"])), F.size(pairs)).alias("monotonicity"))

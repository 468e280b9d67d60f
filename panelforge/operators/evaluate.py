"""Reports on predictions and on two tables that should agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import Axes, div, pearson
from .backtest import double_rank


def regression(df: DataFrame, y: str, pred: str) -> DataFrame:
    """mse, rmse, mae, r2, hit rate and n over rows with both."""
    d = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    e = F.col(y) - F.col(pred)
    a = d.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v"), F.avg((F.signum(y) == F.signum(pred)).cast("double")).alias("hit_rate"), F.count("*").alias("n"))
    return a.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - div(F.col("mse"), F.col("_v"))).alias("r2"), "hit_rate", "n")


def quantile_of(axes: Axes, pred: str, n: Column, q: int) -> Column:
    """Bucket 1..q on ranks 1..n with ties by symbol, cut at equal steps of the rank."""
    part = [c for c in axes.keys if c != axes.symbol]
    k = F.row_number().over(Window.partitionBy(*part).orderBy(F.col(pred).asc_nulls_last(), axes.symbol))
    return F.when(F.col(pred).isNotNull() & (n > 1), F.greatest(F.lit(1), F.ceil((k - 1) * q / F.when(n > 1, n - 1))).cast("int"))


def cross_sections(df: DataFrame, axes: Axes, y: str, pred: str, least: int = 10, q: int = 10, share: float = 0.2) -> DataFrame:
    """Per time: ic, rankic, top less bottom share, mean label and quantile means; missing predictions take no part."""
    part = [c for c in axes.keys if c != axes.symbol]
    d = df.where(F.col(pred).isNotNull())
    x = Window.partitionBy(*part)
    ok = F.col(y).isNotNull()
    d = d.withColumns({"_n": F.count(F.lit(1)).over(x), "_y": F.when(ok, F.col(y)), "_p": F.when(ok, F.col(pred))}).where(F.col("_n") >= least)
    d = d.withColumns(
        {
            "_q": quantile_of(axes, pred, F.col("_n"), q), "_k": F.row_number().over(x.orderBy(pred, axes.symbol)), "_leg": F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)).cast("int")),
            "_ry": F.when(ok, double_rank(F.col("_y"), part)).cast("double"), "_rp": F.when(ok, double_rank(F.col("_p"), part)).cast("double"),
        }
    )
    legs = F.avg(F.when(F.col("_k") > F.col("_n") - F.col("_leg"), F.col(y))) - F.avg(F.when(F.col("_k") <= F.col("_leg"), F.col(y)))
    return d.groupBy(*part).agg(
        F.count("*").alias("n_obs"), F.when(F.count("_y") >= 3, pearson(F.col("_p"), F.col("_y"))).alias("ic"), F.when(F.count("_y") >= 3, pearson(F.col("_rp"), F.col("_ry"))).alias("rankic"),
        legs.alias("long_short_ret"), F.avg(y).alias("benchmark_ret"), *[F.avg(F.when(F.col("_q") == k, F.col(y))).alias(f"q{k}_ret") for k in range(1, q + 1)],
    )


def daily(metrics: DataFrame, day: Column) -> DataFrame:
    g = metrics.groupBy(day.alias("date")).agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg("rankic").alias("rankic_mean"), F.stddev_samp("rankic").alias("rankic_std"),
        F.avg("long_short_ret").alias("long_short_ret_mean"), F.count("*").alias("n_minutes"),
    )
    return g.withColumns({"icir": div(F.col("ic_mean"), F.col("ic_std")), "rankicir": div(F.col("rankic_mean"), F.col("rankic_std"))})


def quantile_table(metrics: DataFrame, q: int, periods: int = 39 * 252) -> DataFrame:
    """Mean return of each quantile, as rows, and at a year's rate."""
    one = metrics.agg(*[F.avg(f"q{k}_ret").alias(f"q{k}_ret") for k in range(1, q + 1)])
    return one.unpivot([], [f"q{k}_ret" for k in range(1, q + 1)], "quantile", "mean_ret").withColumn("annualized_ret", F.col("mean_ret") * periods)


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str, near: float = 1e-6) -> DataFrame:
    """Row ratio, key overlap, parity of missing values, equal share, largest gap of two tables."""
    j = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ia")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_ib")), keys, "full_outer")
    both = F.col("_ia").isNotNull() & F.col("_ib").isNotNull()
    gap = F.abs(F.col("_a") - F.col("_b"))
    return j.agg(
        div(F.least(F.count("_ia"), F.count("_ib")), F.greatest(F.count("_ia"), F.count("_ib"))).alias("row_ratio"), div(F.count_if(both), F.count(F.lit(1))).alias("key_jaccard"),
        F.count_if(both & (F.col("_a").isNull() != F.col("_b").isNull())).alias("missing_differ"),
        div(F.count_if(both & (F.col("_a").eqNullSafe(F.col("_b")) | (gap <= near))), F.count_if(both)).alias("equal_share"),
        F.count_if(both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing"), F.max(F.when(both, gap)).alias("max_gap"),
    )


def agreement(a: DataFrame, b: DataFrame, keys: list[str], time: list[str], value: str, least: float = 0.99) -> DataFrame:
    """Infinite values of both tables, and mean IC and rank IC between them by time, with the verdict on those."""
    bad = lambda c: F.count_if(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    infinite = a.agg(bad(F.col(value)).alias("inf_a")).join(b.agg(bad(F.col(value)).alias("inf_b")))
    clean = lambda t, n: t.select(*keys, F.when(~F.isnan(value) & (F.abs(F.col(value)) < F.lit(float("inf"))), F.col(value)).alias(n))
    j = clean(a, "_a").join(clean(b, "_b"), keys).where("_a is not null and _b is not null")
    j = j.withColumns({"_ra": double_rank(F.col("_a"), time).cast("double"), "_rb": double_rank(F.col("_b"), time).cast("double")})
    by_time = j.groupBy(*time).agg(pearson(F.col("_a"), F.col("_b")).alias("ic"), pearson(F.col("_ra"), F.col("_rb")).alias("rankic"))
    mean = by_time.agg(F.avg("ic").alias("ic"), F.avg("rankic").alias("rankic"))
    return mean.join(infinite).withColumn("agrees", F.coalesce((F.col("ic") > least) & (F.col("rankic") > least), F.lit(False)))


def versus(current: DataFrame, best: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, current, best, bigger) of two tables of one row: which of them has more of each metric."""
    long = lambda t, n: t.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", n)
    j = long(current, "current").join(long(best, "best"), "metric", "full_outer")
    more = F.when(F.col("best").isNull(), "current").when(F.col("current").isNull(), "best").when(F.col("current") > F.col("best"), "current").when(F.col("current") < F.col("best"), "best").otherwise("equal")
    return j.withColumn("bigger", more)


def split_report(df: DataFrame, split: str, axes: Axes, y: str, pred: str, periods: int = 39 * 252) -> DataFrame:
    """One row a split: regression errors, IC and rank IC with their ratios, long-short return and its yearly Sharpe."""
    inner = Axes(axes.time, axes.symbol, split)
    g = cross_sections(df.select(*inner.keys, y, pred), inner, y, pred).groupBy(split).agg(
        F.avg("ic").alias("ic"), div(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.avg("rankic").alias("rankic"), div(F.avg("rankic"), F.stddev_samp("rankic")).alias("rankicir"),
        F.avg("long_short_ret").alias("long_short_ret"), (div(F.avg("long_short_ret"), F.stddev_samp("long_short_ret")) * F.sqrt(F.lit(float(periods)))).alias("sharpe"), F.count("*").alias("n_times"),
    )
    d = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    e = F.col(y) - F.col(pred)
    r = d.groupBy(split).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - div(F.avg(e * e), F.var_pop(y))).alias("r2"), F.avg((F.signum(y) == F.signum(pred)).cast("double")).alias("hit_rate"), F.count("*").alias("n"))
    return r.join(g, split, "left")


def pool_statistics(pool: DataFrame, groups: list[str], round_: str) -> DataFrame:
    """Trajectories in all and by each group, and the last round, as (what, value, n)."""
    total = pool.agg(F.count("*").alias("n")).select(F.lit("total").alias("what"), F.lit("").alias("value"), "n")
    last = pool.agg(F.max(round_).cast("bigint").alias("n")).select(F.lit("last round").alias("what"), F.lit("").alias("value"), "n")
    each = [pool.groupBy(F.col(g).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(g).alias("what"), "value", "n") for g in groups]
    for e in (last, *each):
        total = total.unionByName(e)
    return total


def report_order(df: DataFrame, keys: list[str], phases: list[str], phase: str) -> DataFrame:
    """Rows by ``keys``, where phases come in the order given and unknown ones last."""
    place = F.array_position(F.array(*[F.lit(p) for p in phases]), F.col(phase))
    at = F.when(place > 0, place).otherwise(len(phases) + 1).cast("int")
    return df.withColumn("phase_order", at).orderBy(*["phase_order" if k == phase else k for k in keys])


def quality_gate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df`` with accepted and the names of the checks that fail; a check that is NULL fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return df.withColumn("reasons", failed).withColumn("accepted", F.size("reasons") == 0)


def coverage(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    """Last date of each column, and which of them end first."""
    one = df.agg(*[F.max(F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in columns])
    rows = one.unpivot([], columns, "factor", "last_date")
    return rows.withColumn("bottleneck", F.coalesce(F.col("last_date") == F.min("last_date").over(Window.partitionBy(F.lit(0))), F.lit(False)))


def calibration(df: DataFrame, pred: str, y: str, bins: int = 10) -> DataFrame:
    """Mean prediction and outcome in bins between the quantiles of the prediction."""
    d = df.where(F.col(pred).isNotNull() & F.col(y).isNotNull())
    edges = d.agg(F.percentile(pred, F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("e")).first()["e"] or []
    of = sum((F.when(F.col(pred) >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(1))
    return d.groupBy(of.alias("bin")).agg(F.avg(pred).alias("pred"), F.avg(y).alias("outcome"), F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows of each of ``bins`` equal steps; 0 and bins + 1 hold what lies outside."""
    return df.where(F.col(column).isNotNull()).groupBy(F.width_bucket(column, F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def best_by(df: DataFrame, group: list[str], metric: str) -> DataFrame:
    """The row of the largest absolute metric; ties go to the first name."""
    rest = [c for c in df.columns if c not in group]
    # The smallest of (-metric, the other columns): ties are settled by name.
    return df.groupBy(*group).agg(F.min(F.struct((-F.abs(F.col(metric))).alias("_m"), *rest)).alias("_r")).select(*group, *[F.col(f"_r.{c}").alias(c) for c in rest])

"""Ticks to bars to labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import Axes, div, num


def tick_ns(time_m: Column) -> Column:
    """HH:MM:SS[.frac] as nanoseconds since midnight; what can't be read is NULL."""
    part = lambda at: F.substring(time_m, at, 2).try_cast("bigint")
    frac = F.rpad(F.regexp_replace(F.substring(time_m, 9, 12), "^\\.?", ""), 9, "0").try_cast("bigint")
    return (part(1) * 3600 + part(4) * 60 + part(7)) * 1_000_000_000 + frac


def ns_minute(ns: Column) -> Column:
    """HHMM of nanoseconds since midnight."""
    m = F.floor(ns / F.lit(60_000_000_000)).cast("bigint")
    return (F.floor(m / 60) * 100 + m % 60).cast("int")


def minute_of_day(hhmm: Column) -> Column:
    return (F.floor(hhmm / 100) * 60 + hhmm % 100).cast("int")


def minute_bounds(hhmm: Column) -> tuple[Column, Column]:
    """First nanosecond of a minute HHMM and of the next one."""
    start = minute_of_day(hhmm).cast("bigint") * 60_000_000_000
    return start, start + 60_000_000_000


def minute_label(hhmm: Column) -> Column:
    """HH:MM of HHMM."""
    return F.format_string("%02d:%02d", F.floor(hhmm / 100).cast("int"), (hhmm % 100).cast("int"))


def in_session(hhmm: Column, start: int = 930, end: int = 1559) -> Column:
    return hhmm.between(start, end) & (hhmm % 100 < 60)


def sampled(hhmm: Column, every: int, start: int = 930, end: int = 1559) -> Column:
    """Minutes of the session that lie a multiple of ``every`` after its start."""
    return hhmm.between(start, end) & ((minute_of_day(hhmm) - (start // 100 * 60 + start % 100)) % every == 0)


def valid_quotes(quotes: DataFrame, start: int = 930, end: int = 1559) -> DataFrame:
    """Session and validity filters, then ns, minute, spread, mid and imbalance."""
    q = quotes.withColumn("ns", tick_ns(F.col("time_m"))).withColumn("minute", ns_minute(F.col("ns")))
    q = q.where(in_session(F.col("minute"), start, end) & (F.col("best_bid") > 0) & (F.col("best_ask") > 0) & (F.col("best_bid") <= F.col("best_ask")))
    return q.withColumns(
        {
            "spread": F.col("best_ask") - F.col("best_bid"),
            "mid": (F.col("best_bid") + F.col("best_ask")) * 0.5,
            "imb": num(div(F.col("best_bidsiz") - F.col("best_asksiz"), F.col("best_bidsiz") + F.col("best_asksiz"))),
        }
    )


def minute_bars(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: first, last, max, min, mean, std of spread and mid; mean and std of imbalance."""
    cols = []
    for c, name in (("spread", "spread"), ("mid", "mid_price")):
        # Ticks of one time are ordered by value.
        made = {"first": F.min_by(c, F.struct("ns", c)), "last": F.max_by(c, F.struct("ns", c)), "max": F.max(c), "min": F.min(c), "mean": F.avg(c), "std": F.stddev_samp(c)}
        cols += [f.alias(f"{name}_{k}") for k, f in made.items()]
    return quotes.groupBy(*keys).agg(*cols, F.avg("imb").alias("imbalance_mean"), F.stddev_samp("imb").alias("imbalance_std"), F.count("*").alias("n_ticks"))


def forward_labels(df: DataFrame, price: str, axes: Axes, horizon: int = 10) -> DataFrame:
    """ret and log_ret over the next ``horizon`` rows of a symbol, and both less their mean per time."""
    ahead = F.lead(price, horizon).over(axes.ordered())
    out = df.withColumn("ret", div(ahead, F.col(price)) - 1).withColumn("log_ret", F.log(F.when(F.col("ret") > -1, F.col("ret") + 1)))
    return out.withColumns({f"ex_{c}": F.col(c) - F.avg(c).over(axes.cross()) for c in ("ret", "log_ret")})


def intraday_features(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Price impact (covariance of mid changes and imbalance over its variance), reversals of the mid,
    share of ticks with more on the bid, and the spread's interquartile range."""
    w = Window.partitionBy(*keys).orderBy("ns")
    q = quotes.withColumn("move", F.col("mid") - F.lag("mid").over(w))
    q = q.withColumn("turned", F.signum("move") * F.signum(F.lag("move").over(w)) < 0)
    x, y = F.when(F.col("imb").isNotNull(), F.col("move")), F.when(F.col("move").isNotNull(), F.col("imb"))
    return q.groupBy(*keys).agg(
        div(F.covar_pop(x, y), F.var_pop(F.when(x.isNotNull(), y))).alias("kyle_lambda"), F.count_if("turned").alias("reversals"),
        F.avg((F.col("imb") > 0).cast("double")).alias("imbalance_pos_ratio"), (F.percentile("spread", F.lit(0.75)) - F.percentile("spread", F.lit(0.25))).alias("spread_iqr"),
    )


def duration_stats(quotes: DataFrame, keys: list[str], end_ns: Column) -> DataFrame:
    """Time-weighted mean and deviation of the spread, and its concentration over one-cent steps."""
    w = Window.partitionBy(*keys).orderBy("ns")
    q = quotes.withColumn("dt_ns", (F.coalesce(F.lead("ns").over(w), end_ns) - F.col("ns")).cast("double"))
    cents = q.groupBy(*keys, F.round(F.col("spread") * 100).alias("cent")).agg(
        F.sum("dt_ns").alias("t"), F.sum(F.col("dt_ns") * F.col("spread")).alias("s"), F.sum(F.col("dt_ns") * F.col("spread") * F.col("spread")).alias("ss")
    )
    out = cents.groupBy(*keys).agg(F.sum("t").alias("t"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    mean = div(F.col("s"), F.col("t"))
    return out.select(*keys, mean.alias("tw_mean"), F.sqrt(F.greatest(div(F.col("ss"), F.col("t")) - mean * mean, F.lit(0.0))).alias("tw_std"), div(F.col("tt"), F.col("t") * F.col("t")).alias("hhi"))

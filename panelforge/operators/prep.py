"""Feature and label preparation inside cross-sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import Axes, div

LABEL_MODES = ("raw", "winsorize", "winsorize_zscore", "winsorize_rank_zscore", "rank")


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def winsor_zscore(df: DataFrame, axes: Axes, columns: list[str], q: float = 0.01) -> DataFrame:
    """Clip to the q and 1-q quantiles (of five values and more), then z; flat slices give 0."""
    c = axes.cross()
    n = {x: F.count(x).over(c) for x in columns}
    edge = {x: F.percentile(x, F.array(F.lit(q), F.lit(1 - q))).over(c) for x in columns}
    out = df.withColumns({f"_n_{x}": n[x] for x in columns} | {f"_q_{x}": edge[x] for x in columns})
    out = out.withColumns({f"_c_{x}": F.when(F.col(f"_n_{x}") >= 5, _clip(F.col(x), F.col(f"_q_{x}")[0], F.col(f"_q_{x}")[1])).otherwise(F.col(x)) for x in columns})
    out = out.withColumns({f"_m_{x}": F.avg(f"_c_{x}").over(c) for x in columns} | {f"_s_{x}": F.stddev_samp(f"_c_{x}").over(c) for x in columns})
    normal = lambda x: (F.col(f"_n_{x}") >= 2) & (F.col(f"_s_{x}") >= 1e-12)
    z = {x: F.when(normal(x), F.coalesce(div(F.col(f"_c_{x}") - F.col(f"_m_{x}"), F.col(f"_s_{x}")), F.lit(0.0))).when(F.col(x).isNotNull(), F.lit(0.0)) for x in columns}
    return out.withColumns(z).select(*df.columns)


def winsorize_by(df: DataFrame, slot: list[str], column: str, q: float, out: str) -> DataFrame:
    """Clip a column within a slot over all dates (which reads dates to come)."""
    w = Window.partitionBy(*slot)
    x = F.col(column)
    d = df.withColumns({"_n": F.count(x).over(w), "_q": F.percentile(x, F.array(F.lit(q), F.lit(1 - q))).over(w)})
    return d.withColumn(out, F.when(F.col("_n") >= 5, _clip(x, F.col("_q")[0], F.col("_q")[1])).otherwise(x)).drop("_n", "_q")


def _z_or_raw(df: DataFrame, part: list[str], value: str, raw: str, out: str, least: int = 5) -> DataFrame:
    w = Window.partitionBy(*part)
    d = df.withColumns({"_n": F.count(raw).over(w), "_m": F.avg(value).over(w), "_s": F.stddev_samp(value).over(w)})
    skip = (F.col("_n") < least) | F.col("_s").isNull() | (F.col("_s") < 1e-8)
    return d.withColumn(out, F.coalesce(F.when(skip, F.col(raw)).otherwise(div(F.col(value) - F.col("_m"), F.col("_s"))), F.lit(0.0))).drop("_n", "_m", "_s")


def _avg_rank(x: str, part: list[str]) -> Column:
    r = F.rank().over(Window.partitionBy(*part).orderBy(F.col(x).asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*part, x)) - 1) / F.lit(2.0)
    return F.when(F.col(x).isNotNull(), r)


def training_label(df: DataFrame, axes: Axes, column: str, mode: str, slot: list[str], q: float = 0.01, out: str = "label") -> DataFrame:
    """A label to train on; ``slot`` is what the winsorising and rank modes group by, over all dates."""
    if mode not in LABEL_MODES:
        raise ValueError(f"no such label mode: {mode}")
    part = [c for c in axes.keys if c != axes.symbol]
    if mode == "raw":
        return df.withColumn(out, F.col(column))
    if mode == "rank":
        d = df.withColumn("_k", _avg_rank(column, slot))
        w = Window.partitionBy(*slot)
        return d.withColumn(out, F.coalesce(div(F.col("_k") - F.avg("_k").over(w), F.stddev_samp("_k").over(w)), F.lit(0.0))).drop("_k")
    d = winsorize_by(df, slot, column, q, "_c")
    if mode == "winsorize":
        return d.withColumnRenamed("_c", out)
    if mode == "winsorize_zscore":
        return _z_or_raw(d, part, "_c", "_c", out).drop("_c")
    return _z_or_raw(d.withColumn("_k", _avg_rank("_c", part)), part, "_k", "_c", out).drop("_c", "_k")


def relevance(df: DataFrame, axes: Axes, column: str, bins: int = 10, out: str = "relevance") -> DataFrame:
    """Equal-count grades 0..bins-1 in a cross-section; ties stand by symbol; missing labels have none."""
    part = [c for c in axes.keys if c != axes.symbol]
    k = F.row_number().over(Window.partitionBy(*part).orderBy(F.col(column).asc_nulls_last(), axes.symbol))
    n = F.count(column).over(Window.partitionBy(*part))
    d = df.withColumns({"_k": k, "_n": n})
    grade = F.expr(f"least({bins - 1}, ((_k - 1) * {bins}) div greatest(_n, 1))").cast("int")
    return d.withColumn(out, F.when(F.col(column).isNotNull(), grade)).drop("_k", "_n")


def global_zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation over all rows, missing as 0; one aggregate, one row to the driver."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scale = {c: s if (s := stats[f"s_{c}"]) is not None and s >= 1e-12 else 1.0 for c in columns}
    return df.withColumns({c: F.coalesce((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(scale[c]), F.lit(0.0)) for c in columns})


def lagged(df: DataFrame, axes: Axes, columns: list[str], lag: int) -> DataFrame:
    """Features of ``lag`` rows before, labels in place; rows without all features go."""
    return df.withColumns({c: F.lag(c, lag).over(axes.ordered()) for c in columns}).dropna(subset=columns)

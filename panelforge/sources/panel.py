"""Where panels come from: adapters of the driver's tables, long and wide sources, PIT universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import rounded
from ..functions.windows import Axes, num

MONTHS = Axes("dt", "sym", None)
KEYS = ("date", "sym_root", "sym_suffix", "minute")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a supplier and month: price, qty, vol, n and x, a price with holes."""
    line = table(spark, sf_dir, "lineitem")
    dt = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("dt")
    a = line.groupBy(dt, F.col("l_suppkey").alias("sym")).agg(
        rounded(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 6).alias("price"),
        rounded(F.avg("l_quantity"), 6).alias("qty"),
        F.sum("l_quantity").alias("vol"),
        F.count("*").alias("n"),
    )
    return a.withColumn("x", F.when(~((F.col("sym") % 7 == 0) & (F.month("dt") % 5 == 0)), F.col("price")))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: event_type quotes value and a little more, with sizes that can both be 0."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.to_date("ts").alias("date"), F.col("event_type").alias("sym_root"), F.lit(None).cast("string").alias("sym_suffix"), F.date_format("ts", "HH:mm:ss.SSSSSS").alias("time_m"),
        F.col("value").alias("best_bid"), (F.col("value") + 0.01 * (F.col("event_id") % 7)).alias("best_ask"), (F.col("user_id") % 13).cast("double").alias("best_bidsiz"), (F.col("event_id") % 11).cast("double").alias("best_asksiz"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership intervals by supplier: always, until mid 1998, open end, from 1999 on."""
    k = F.col("s_suppkey") % 4
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sym"),
        F.when(k == 3, F.to_date(F.lit("1999-01-01"))).otherwise(F.to_date(F.lit("1900-01-01"))).alias("in_date"),
        F.when(k == 1, F.to_date(F.lit("1998-06-01"))).when(k == 2, F.lit(None).cast("date")).otherwise(F.to_date(F.lit("2100-01-01"))).alias("out_date"),
    )


# -- general readers -----------------------------------------------------------------


def canonical_suffix(c: Column) -> Column:
    """NULL, '' and 'None' are all no suffix."""
    return F.when(c.isNull() | F.trim(c).isin("", "None"), F.lit("")).otherwise(F.trim(c))


def ticker(root: str = "sym_root", suffix: str = "sym_suffix") -> Column:
    s = canonical_suffix(F.col(suffix))
    return F.when(s == "", F.col(root)).otherwise(F.concat_ws(".", F.col(root), s))


def split_ticker(c: Column) -> tuple[Column, Column]:
    parts = F.split(c, "\\.", 2)
    return parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def canonical_date(c: Column) -> Column:
    """2025-01-15, 20250115 (text or number) and dates as a date."""
    return F.to_date(F.regexp_replace(c.cast("string").substr(1, 10), "-", ""), "yyyyMMdd")


def read_long(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A long panel, one row a key; columns and dates are pruned in the scan."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df if columns is None else df.select(*[c for c in KEYS if c in df.columns], *[c for c in columns if c in df.columns])


def is_long(df: DataFrame) -> bool:
    return set(KEYS) <= set(df.columns)


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow file, which Spark has no reader for: read on the driver, so for small files."""
    import pyarrow.feather

    return spark.createDataFrame(pyarrow.feather.read_table(path).to_pandas())


def detect(df: DataFrame) -> dict[str, str | None]:
    """What a table is: long (all KEYS) or wide (a time column and tickers), and its time column."""
    if is_long(df):
        return {"layout": "long", "time": "date"}
    time = next((c for c in df.columns if c.lower() in ("datetime", "time", "timestamp", "date")), None)
    time = time or next((f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date")), None)
    return {"layout": "wide" if time else "unknown", "time": time}


def open_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str | None]]:
    """A parquet file or folder, or an Arrow file, and what it is."""
    df = read_feather(spark, path) if path.endswith((".feather", ".arrow")) else spark.read.option("mergeSchema", "true").parquet(path)
    return df, detect(df) | {"format": "feather" if path.endswith((".feather", ".arrow")) else "parquet"}


def list_days(df: DataFrame, date: str = "date") -> DataFrame:
    """The days of a store, in order; of a partitioned one only folders are read."""
    return df.select(canonical_date(F.col(date)).alias("date")).distinct().orderBy("date")


def with_panel_keys(df: DataFrame) -> DataFrame:
    """Adds stock_code and datetime to a long panel: ticker, and date with the minute HHMM filled up to four digits."""
    text = F.concat(F.date_format(canonical_date(F.col("date")), "yyyyMMdd"), F.lpad(F.col("minute").cast("string"), 4, "0"))
    return df.withColumns({"stock_code": ticker(), "datetime": F.to_timestamp_ntz(text, F.lit("yyyyMMddHHmm"))})


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of research results, which must have a column ``factor``."""
    df = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    if "factor" not in df.columns:
        raise ValueError(f"{path} has no column factor")
    return df


def wide_to_long(df: DataFrame, time: str, value: str) -> DataFrame:
    """One column a ticker to rows of date, minute (HHMM), ticker."""
    long = df.unpivot(time, [c for c in df.columns if c != time], "ticker", value)
    long = long.select(F.to_date(time).alias("date"), (F.hour(time) * 100 + F.minute(time)).alias("minute"), "ticker", num(F.col(value).cast("double")).alias(value))
    return long.where(F.col(value).isNotNull())


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document with an array of membership intervals."""
    rows = spark.read.option("multiLine", "true").json(path).select(F.explode("universe").alias("u")).select("u.*")
    return rows.select(
        F.col("wrds_sym_root").alias("sym_root"), canonical_suffix(F.col("wrds_sym_suffix").cast("string")).alias("sym_suffix"),
        canonical_date(F.col("in_date")).alias("in_date"), canonical_date(F.col("out_date")).alias("out_date"),
    )


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", "true").csv(path)
    return df.select(canonical_date(F.col("trade_date" if "trade_date" in df.columns else df.columns[0])).alias("date")).where("date is not null").distinct()


class FeatureCatalog:
    """Which relation owns a field: a feature's own directory before a panel's column."""

    def __init__(self, panel: DataFrame | None = None, features: dict[str, DataFrame] | None = None, keys: tuple[str, ...] = KEYS):
        self.panel, self.features, self.keys = panel, features or {}, keys

    def fields(self) -> list[str]:
        own = [c for c in self.panel.columns if c not in self.keys] if self.panel is not None else []
        return list(dict.fromkeys([*self.features, *own]))

    def for_expression(self, expression: str) -> DataFrame:
        """The keys and the fields that an expression reads."""
        from ..plans.parser import fields, parse

        return self.load(list(dict.fromkeys(fields(parse(expression)))))

    @staticmethod
    def merged(*names: list[str]) -> list[str]:
        """Names of several registries in order, once each, without blanks."""
        return list(dict.fromkeys(n.strip() for part in names for n in part if n and n.strip()))

    def load(self, names: list[str]) -> DataFrame:
        """Full outer join of the fields on the keys; one scan for all that the panel owns."""
        if unknown := [n for n in names if n not in self.fields()]:
            raise KeyError(f"no such fields: {unknown}")
        shared = [n for n in names if n not in self.features]
        parts = [self.panel.select(*self.keys, *shared)] if shared else []
        parts += [self.features[n].select(*self.keys, n) for n in names if n in self.features]
        out = parts[0]
        for p in parts[1:]:
            out = out.join(p, list(self.keys), "full_outer")
        return out.select(*self.keys, *names)

"""Where results go."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def assert_safe(path: str, read_only: tuple[str, ...] = ()) -> str:
    """Refuses a path below a read-only root."""
    clean = posixpath.normpath(path)
    for root in map(posixpath.normpath, read_only):
        if clean == root or clean.startswith(root + "/"):
            raise PermissionError(f"{path} lies below {root}, which is read-only")
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only on a local master where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder all executors share and read back: later plans start there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_model(spark: SparkSession, path: str, weights: dict[str, float], meta: dict[str, str], read_only: tuple[str, ...] = ()) -> None:
    """A linear model as two CSV folders: coefficients by size, and what it was fitted with."""
    assert_safe(path, read_only)
    rows = spark.createDataFrame(list(weights.items()), "feature string, weight double")
    rows.orderBy(F.abs("weight").desc(), "feature").coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/coefficients")
    spark.createDataFrame([(k, str(v)) for k, v in meta.items()], "name string, value string").coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/meta")


def read_model(spark: SparkSession, path: str) -> tuple[dict[str, float], dict[str, str]]:
    w = spark.read.schema("feature string, weight double").option("header", "true").csv(f"{path}/coefficients").collect()
    m = spark.read.schema("name string, value string").option("header", "true").csv(f"{path}/meta").collect()
    return {r["feature"]: r["weight"] for r in w}, {r["name"]: r["value"] for r in m}


class FactorLibrary:
    """A table of factors by id (md5 of name and expression) with where each one's values are kept."""

    SCHEMA = "id string, name string, expression string, path string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def add(self, factors: DataFrame) -> DataFrame:
        """Adds (name, expression, path) rows; those of known ids replace the old ones."""
        new = factors.select(factor_id().alias("id"), "name", "expression", "path").dropDuplicates(["id"])
        both = shared_table(upsert(self.read(), new, "id"), "library")
        both.write.mode("overwrite").parquet(self.path)
        return self.read()

    def status(self, wanted: DataFrame) -> DataFrame:
        """(name, expression, id, cached) of wanted factors."""
        known = self.read().where("path is not null").select("id", F.lit(True).alias("cached"))
        return wanted.withColumn("id", factor_id()).join(known, "id", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def write_days(df: DataFrame, path: str, read_only: tuple[str, ...] = (), date: str = "date") -> None:
    """A folder a day, zstd; days of ``df`` are replaced, others stay."""
    writer = df.repartition(date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy(date).parquet(assert_safe(path, read_only))


def write_metrics(df: DataFrame, path: str, digits: dict[str, int], read_only: tuple[str, ...] = ()) -> None:
    """CSV with rounded columns."""
    out = df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])
    out.write.mode("overwrite").option("header", "true").csv(assert_safe(path, read_only))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and of ``old`` where the key is not new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def factor_id(name: str = "name", expression: str = "expression"):
    return F.substring(F.md5(F.concat_ws("_", F.col(name), F.col(expression))), 1, 16)

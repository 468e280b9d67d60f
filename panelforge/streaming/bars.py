"""Minute bars over a stream: watermark, event-time windows, append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, time: str, symbol: str, value: str, width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """first, last, max, min, mean, std, n of ``value`` per symbol and window; the same plan reads a batch."""
    t = ticks.withWatermark(time, late) if ticks.isStreaming else ticks
    g = t.groupBy(F.window(time, width).alias("w"), symbol).agg(
        F.min_by(value, time).alias("first"), F.max_by(value, time).alias("last"), F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n")
    )
    return g.select(F.col("w.start").alias("start"), symbol, "first", "last", "max", "min", "mean", "std", "n")


def bars_of_stream(spark: SparkSession, path: str, schema: str, sink: str, checkpoint: str, time: str, symbol: str, value: str, width: str, late: str = "2 minutes") -> DataFrame:
    """Bars of all files of ``path`` by a stream that runs until it has read them; its last state is what counts."""
    # Watermarks need an instant: a time without zone is read in the session's.
    ticks = spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/state={number}")

    run = streaming_bars(ticks, time, symbol, value, width, late).writeStream.outputMode("complete").foreachBatch(each)
    query = run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    number = last["batchId"] if last else 0
    return spark.read.parquet(f"{sink}/state={number}")


def incremental_days(ticks: DataFrame, sink: str, checkpoint: str, transform) -> None:
    """Process what a file source has not given yet, once: ``transform`` maps each batch, written by date.

    A batch's folders carry its number, so a batch that is tried again replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        out = transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("date", "batch").parquet(sink)

    ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

"""Execution-log usage as a stream over arriving JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.sources.tables import LOG_SCHEMA


def log_stream(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def usage_by_window(log: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls, failures and mean duration per operation and time window.

    Works on a stream (rows later than the watermark are left out) and on a
    plain DataFrame.
    """
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "op")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum((~F.col("ok")).cast("long")).alias("failures"), F.avg("duration_ms").alias("mean_ms"))
        .select(F.col("window.start").alias("window_start"), "op", "calls", "failures", "mean_ms")
    )


def write_usage(log: DataFrame, out: str, checkpoint: str, width: str = "1 hour", late: str = "2 hours"):
    """Append finished windows as parquet; processes what is there and stops."""
    return usage_by_window(log, width, late).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)

"""Line-level helpers shared by the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """One row per record of a text file cut at ``separator`` (splittable)."""
    return spark.read.option("lineSep", separator).text(path)


def numbered_lines(spark: SparkSession, path: str, blank: bool = True) -> DataFrame:
    """Lines with their file and exact zero-based line number; without ``blank``, blank lines are neither given nor counted.

    Row ids grow inside a file split, so a line's number is the count of lines
    in earlier splits of the file plus its distance from the first id of its
    own split; only one small row per split is ordered.
    """
    lines = spark.read.text(path)
    raw = (lines if blank else lines.where(F.col("value").rlike(r"\S"))).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id")
    )
    splits = raw.groupBy("file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return raw.join(offsets, ["file", "_split"]).select("file", (F.col("_off") + F.col("_id") - F.col("_first")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def lenient_text(spark: SparkSession, value: Column) -> Column:
    """Valid UTF-8 as it is, otherwise decoded as GBK, per record."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return F.when(F.is_valid_utf8(value), value).otherwise(F.decode(value.cast("binary"), "GBK"))

"""Shared scratch storage: checkpoints and files that all executors can see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where unset, a local one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    fresh = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


def scratch_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def stored(df: DataFrame, stem: str = "step") -> DataFrame:
    """Write to the shared folder and read again: later steps neither recompute it nor depend on executors' disks."""
    path = scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise on shared storage so that iterative plans stay short."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy text work when the scan has few splits.

    A large input already has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_rows(df: DataFrame) -> DataFrame:
    """Use all cores for costly expressions on few result rows.

    Adaptive execution folds small results into one task; a partition count
    given here is kept.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)

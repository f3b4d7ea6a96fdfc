"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.plans.storage import scratch_path


#: Bytes of text that a task turns into Python objects at once.
SLICE = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches after every ``SLICE`` bytes of the text ``columns``; views, no copies; a longer text is a slice of its own."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        at = 0
        for end in [*(np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1).tolist(), len(size)]:
            if end > at:
                yield batch.slice(at, end - at)
            at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths written inside the open scopes of :func:`scratch`, innermost last.
_SCOPES: list[list[str]] = []


def stored(df: DataFrame, stem: str = "step") -> DataFrame:
    """Write to the shared folder and read again: later steps neither recompute it nor depend on executors' disks."""
    path = scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """What is stored inside is deleted at the end, but for what the given function stores: that belongs to the scope outside."""
    _SCOPES.append([])

    def keep(df: DataFrame, stem: str = "kept") -> DataFrame:
        found = stored(df, stem)
        path = _SCOPES[-1].pop()
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(path)
        return found

    try:
        yield keep
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _SCOPES.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


#: Keys of at most so many bytes are sent to every executor to pick rows; more are joined by shuffle.
SENT_BYTES, KEY_BYTES = 16 << 20, 32


def picked(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` semi- or anti-joined to distinct ``keys`` (one column of the same name) without moving the rows where the keys are few."""
    few = keys.count() * KEY_BYTES <= SENT_BYTES
    return rows.join(F.broadcast(keys) if few else keys, keys.columns, how)


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every id in ``links`` (columns ``a``, ``b``).

    Labels take the smallest label among neighbours, then jump to the label of
    their label, so chains shorten by halves.  Ids without a link are absent;
    null ids and self links are ignored.
    """
    flat = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = stored(flat.union(flat.select("b", "a")).toDF("u", "v").distinct(), "edges")
    labels = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component"))
    labels = stored(labels, "labels")
    while True:
        near = (
            edges.join(labels.select(F.col("id").alias("v"), "component"), "v")
            .groupBy(F.col("u").alias("id")).agg(F.min("component").alias("m"))
        )
        lower = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("j"))
        labels2 = stored(lower.join(jump, "c", "left").select("id", "was", F.least("c", F.coalesce("j", "c")).alias("component")), "labels")
        moved = labels2.where("component <> was").limit(1).count()
        labels = labels2.select("id", "component")
        if not moved:
            return labels


def fresh_name(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex[:8]}"

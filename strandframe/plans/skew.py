"""Salted equi-joins for keys that hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of more than ``hot_rows`` rows and their number of salts: at most ``rows / hot_rows`` entries."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: str | Sequence[str], hot_rows: int = HOT_ROWS, how: str = "inner", hot: DataFrame | None = None,
) -> DataFrame:
    """Inner or left join that cuts every key with more than ``hot_rows`` left rows.

    Left rows of a hot key go to ``ceil(n / hot_rows)`` salts by a hash of
    ``spread_by``; the right rows of that key are repeated once per salt.  ``hot``
    may hand in the :func:`hot_keys` of the left rows; their list is broadcast.
    """
    keys, by = list(keys), [spread_by] if isinstance(spread_by, str) else list(spread_by)
    hot = F.broadcast(hot_keys(left, keys, hot_rows) if hot is None else hot)
    salts = F.coalesce("_salts", F.lit(1))
    lefts = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("_salts")
    rights = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return lefts.join(rights, [*keys, "_salt"], how).drop("_salt")

"""Ordered scans that never put one whole group into one task.

A window over ``partitionBy(group)`` sends a hot group to a single task.  The
helpers here cut the order axis of every group into blocks, run the window
inside a block, and carry a per-block summary across blocks:

* integer axes (coordinates, days) use fixed-width blocks;
* real-valued axes use blocks between approximate quantiles, whose split
  points are a bounded array computed once, so a row's block is a pure
  function of its value and survives recomputation after a lost executor.

Callers aggregate equal order keys first, so a block holds distinct keys only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.plans.storage import cut_lineage

N_BLOCKS = 256
#: Blocks that one window orders at once.
SPAN = 1024

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(fn: str, a: Column, b: Column) -> Column:
    if fn == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if fn == "max" else F.least(a, b)


def width_block(pos: str | Column, width: int) -> Column:
    """Block number of an integer position."""
    col = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(col / F.lit(width)).cast("long")


def present(df: DataFrame, value: str) -> DataFrame:
    """Rows with a value: neither null nor NaN."""
    rows = df.where(F.col(value).isNotNull())
    return rows.where(~F.isnan(value)) if df.schema[value].dataType.typeName() in ("float", "double") else rows


def value_block(df: DataFrame, value: str, out: str = "_block", n: int = N_BLOCKS) -> DataFrame:
    """Add the quantile block of a real-valued column (nulls must be gone; NaN rows are left out)."""
    df = present(df, value)
    probs = [i / n for i in range(1, n)]
    cuts = df.approxQuantile(value, probs, 0.5 / n)
    cuts = sorted({float(c) for c in cuts})
    if len(cuts) < 2:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    tmp = f"_{out}_in"
    staged = df.withColumn(tmp, F.col(value).cast("double"))
    marked = Bucketizer(splits=splits, inputCol=tmp, outputCol=out).transform(staged)
    return marked.drop(tmp).withColumn(out, F.col(out).cast("int"))


def _frame(keys: Sequence[str], order: Sequence[str], side: str) -> Window:
    """Rows on one side of the current one.  Rows after it are those before it in falling order: a frame without an
    end is summed anew for every row."""
    back = side in ("after", "onward")
    by = [F.col(c).desc() if back else F.col(c).asc() for c in order]
    return Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if side in ("upto", "onward") else -1)


def _carried(totals: DataFrame, keys: list[str], block: str, specs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """What the other blocks carry into every block, over spans of ``SPAN`` blocks, so that no task orders all blocks of a key."""
    spans = totals.withColumn("_span", F.floor(F.col(block) / SPAN).cast("long"))
    strict = {"upto": "before", "onward": "after"}
    near = spans.select(
        *keys, block, "_span",
        *[_AGG[fn](f"_tot_{out}").over(_frame([*keys, "_span"], [block], strict.get(side, side))).alias(f"_near_{out}") for out, _, fn, side in specs],
    )
    sums = spans.groupBy(*keys, "_span").agg(*[_AGG[fn](f"_tot_{out}").alias(f"_sum_{out}") for out, _, fn, _ in specs])
    far = sums.select(
        *keys, "_span",
        *[_AGG[fn](f"_sum_{out}").over(_frame(keys, ["_span"], strict.get(side, side))).alias(f"_far_{out}") for out, _, fn, side in specs],
    )
    both = near.join(far, [*keys, "_span"], "left")
    return both.select(*keys, block, *[_combine(fn, F.col(f"_near_{out}"), F.col(f"_far_{out}")).alias(f"_carry_{out}") for out, _, fn, _ in specs])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: str,
    specs: Sequence[tuple[str, str, str, str]],
) -> DataFrame:
    """Running aggregates over ``order`` inside ``keys``.

    ``specs`` holds ``(output, input column, 'sum'|'max'|'min', side)`` where
    side is ``before`` / ``upto`` (rows up to the current one, without / with
    it) or ``after`` / ``onward``.  ``block`` must be monotone in ``order``.
    """
    keys = list(keys)
    # one shuffle serves the window inside blocks and the block totals
    df = df.repartition(*keys, block)
    totals = df.groupBy(*keys, block).agg(
        *[_AGG[fn](F.col(src)).alias(f"_tot_{out}") for out, src, fn, _ in specs]
    )
    local = df.select(
        "*",
        *[_AGG[fn](F.col(src)).over(_frame([*keys, block], order, side)).alias(f"_loc_{out}") for out, src, fn, side in specs],
    )
    joined = local.join(_carried(totals, keys, block, specs), [*keys, block], "left")
    result = joined.select(
        *[c for c in df.columns],
        *[_combine(fn, F.col(f"_loc_{out}"), F.col(f"_carry_{out}")).alias(out) for out, _, fn, _ in specs],
    )
    return result


def row_positions(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Global one-based position of every row in ``order``.

    Rows are range-partitioned, stored once so that the ranges stay fixed, and
    numbered inside their range after an offset per range is known.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranged.withColumn("_i", inside).join(offsets, "_range")
    return numbered.withColumn(out, F.col("_off") + F.col("_i")).drop("_range", "_i", "_off")


def tallied(df: DataFrame, keys: Sequence[str], value: str, n_blocks: int = N_BLOCKS) -> DataFrame:
    """Distinct values per group with their count ``_n`` and block."""
    pre = present(df, value).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return value_block(pre, value, "_block", n_blocks)


def midranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with ``n_ties``, ``n_less`` and ``midrank``."""
    ranked = running(tallied(df, keys, value), keys, [value], "_block", [("n_less", "_n", "sum", "before")])
    return ranked.select(
        *keys,
        value,
        F.col("_n").alias("n_ties"),
        "n_less",
        (F.col("n_less") + (F.col("_n") + 1) / 2.0).alias("midrank"),
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], n_blocks: int = N_BLOCKS
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per entry.

    Block counts locate the block that holds each wanted rank; only the rows
    of those blocks are then ordered.
    """
    keys = list(keys)
    pre = tallied(df, keys, value, n_blocks)
    across = Window.partitionBy(*keys)
    blocks = (
        pre.groupBy(*keys, "_block")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_hi", F.sum("_bn").over(across.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_bn").over(across))
        .withColumn("_lo", F.col("_hi") - F.col("_bn"))
    )
    spots = []
    for name, p in probs.items():
        h = F.lit(p) * (F.col("_total") - 1)
        base = F.floor(h)
        spots.append(F.struct(F.lit(name).alias("q"), base.alias("r"), (F.lit(1.0) - (h - base)).alias("w")))
        spots.append(F.struct(F.lit(name).alias("q"), (base + 1).alias("r"), (h - base).alias("w")))
    wanted = (
        blocks.select(*keys, "_block", "_lo", "_hi", F.explode(F.array(*spots)).alias("s"))
        .where((F.col("s.r") >= F.col("_lo")) & (F.col("s.r") < F.col("_hi")) & (F.col("s.w") > 0))
        .groupBy(*keys, "_block")
        .agg(F.max("_lo").alias("_lo"), F.collect_list("s").alias("_spots"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(value)
    near = pre.join(wanted, [*keys, "_block"]).withColumn(
        "_to", F.col("_lo") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    hits = near.select(
        *keys,
        F.col(value).alias("_v"),
        F.explode(
            F.filter("_spots", lambda s: (s["r"] >= F.col("_to") - F.col("_n")) & (s["r"] < F.col("_to")))
        ).alias("s"),
    )
    return hits.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("s.q") == name, F.col("_v") * F.col("s.w"))).alias(name)
            for name in probs
        ]
    )

"""Interval joins and sweeps over (chrom, start0, end0), half-open."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import coordinates
from strandframe.plans import scan, skew

_SPAN = 1 << 16
_FAN = 8


def _grid(a: DataFrame, b: DataFrame) -> tuple[int, int]:
    """Bin width (95th percentile of length) and number of bin levels."""
    lengths = a.select((F.col("end0") - F.col("start0")).alias("n")).unionAll(b.select((F.col("end0") - F.col("start0")).alias("n")))
    p95 = lengths.approxQuantile("n", [0.95, 1.0], 0.01)
    if not p95:
        return 1, 1
    width = max(1, int(p95[0]))
    longest = lengths.agg(F.max("n")).first()[0] or 1
    levels = 1 + max(0, math.ceil(math.log(max(longest / width, 1), _FAN)))
    return width, levels


def _binned(df: DataFrame, width: int, levels: int) -> DataFrame:
    """Rows per (level, bin): own level is the first whose bins are as wide as
    the interval, so every interval meets at most two bins on each level."""
    n = F.col("end0") - F.col("start0")
    own = F.lit(levels - 1)
    for lev in range(levels - 2, -1, -1):
        own = F.when(n <= width * _FAN**lev, F.lit(lev)).otherwise(own)
    spots = []
    for lev in range(levels):
        w = width * _FAN**lev
        first, last = F.floor(F.col("start0") / w), F.floor((F.col("end0") - 1) / w)
        spots.append(
            F.when(
                F.col("_own") <= lev,
                F.sequence(first, last),
            ).otherwise(F.array().cast("array<bigint>"))
        )
    tagged = df.where(n > 0).withColumn("_own", own)
    pairs = F.flatten(F.array(*[F.transform(s, _level_tag(i)) for i, s in enumerate(spots)]))
    return tagged.withColumn("_spot", F.explode(pairs)).select("*", F.col("_spot.lev").alias("_lev"), F.col("_spot.bin").alias("_bin")).drop("_spot")


def _level_tag(lev: int):
    return lambda k: F.struct(F.lit(lev).alias("lev"), k.alias("bin"))


def find_overlaps(a: DataFrame, b: DataFrame, a_id: str, b_id: str, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """All pairs of overlapping intervals with their overlap length.

    Bins of growing width keep the row growth bounded for long intervals; a
    pair is kept only in the bin of its later start, and bins with very many
    left rows are salted.
    """
    width, levels = _grid(a, b)
    left = _binned(a.select(F.col(a_id).alias("_ia"), "chrom", "start0", "end0"), width, levels).select(
        "_ia", "chrom", F.col("start0").alias("_s1"), F.col("end0").alias("_e1"), F.col("_own").alias("_o1"), "_lev", "_bin"
    )
    right = _binned(b.select(F.col(b_id).alias("_ib"), "chrom", "start0", "end0"), width, levels).select(
        "_ib", "chrom", F.col("start0").alias("_s2"), F.col("end0").alias("_e2"), F.col("_own").alias("_o2"), "_lev", "_bin"
    )
    joined = skew.salted_join(left, right, ["chrom", "_lev", "_bin"], "_ia", hot_rows)
    later = F.greatest("_s1", "_s2")
    step = F.lit(width) * F.pow(F.lit(float(_FAN)), F.col("_lev")).cast("long")
    kept = joined.where(
        (F.col("_lev") == F.greatest("_o1", "_o2"))
        & (F.col("_s1") < F.col("_e2"))
        & (F.col("_s2") < F.col("_e1"))
        & (F.floor(later / step) == F.col("_bin"))
    )
    return kept.select(
        F.col("_ia").alias(a_id),
        F.col("_ib").alias(b_id),
        "chrom",
        coordinates.overlap_length(F.col("_s1"), F.col("_e1"), F.col("_s2"), F.col("_e2")).alias("overlap"),
    )


def count_overlaps(a: DataFrame, b: DataFrame, a_id: str) -> DataFrame:
    """How many intervals of ``b`` overlap each interval of ``a``, zeros kept.

    No pair is formed: the count is (starts before my end) - (ends up to my
    start), both read from one running scan over positions.
    """
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    asked = a.where(F.col("end0") > F.col("start0")).select(F.col(a_id), "chrom", "start0", "end0")
    solid = b.where(F.col("end0") > F.col("start0"))
    marks = (
        solid.select("chrom", F.col("start0").alias("pos"), one.alias("ns"), zero.alias("ne"))
        .unionAll(solid.select("chrom", F.col("end0").alias("pos"), zero.alias("ns"), one.alias("ne")))
        .unionAll(asked.select("chrom", F.explode(F.array("start0", "end0")).alias("pos"), zero.alias("ns"), zero.alias("ne")))
        .groupBy("chrom", "pos")
        .agg(F.sum("ns").alias("ns"), F.sum("ne").alias("ne"))
        .withColumn("_block", scan.width_block("pos", _SPAN))
    )
    totals = scan.running(marks, ["chrom"], ["pos"], "_block", [("started", "ns", "sum", "before"), ("ended", "ne", "sum", "upto")])
    at_end = totals.select("chrom", F.col("pos").alias("end0"), "started")
    at_start = totals.select("chrom", F.col("pos").alias("start0"), "ended")
    return (
        asked.join(at_end, ["chrom", "end0"]).join(at_start, ["chrom", "start0"]).select(a_id, (F.col("started") - F.col("ended")).alias("n_overlaps"))
    )


def subset_by_overlap(a: DataFrame, b: DataFrame, a_id: str) -> DataFrame:
    """Intervals of ``a`` that overlap any of ``b``."""
    return a.join(count_overlaps(a, b, a_id).where(F.col("n_overlaps") > 0).select(a_id), a_id, "left_semi")


def _islands(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Distinct starts with the furthest end seen before them."""
    furthest = df.where(F.col("end0") > F.col("start0")).groupBy(*by, "start0").agg(F.max("end0").alias("end0")).withColumn(
        "_block", scan.width_block("start0", _SPAN)
    )
    return scan.running(furthest, by, ["start0"], "_block", [("_reach", "end0", "max", "before")])


def merge_intervals(df: DataFrame, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Union of overlapping and touching intervals."""
    reach = _islands(df, by)
    opening = reach.where(F.col("_reach").isNull() | (F.col("start0") > F.col("_reach"))).select(*by, "start0", "_block", "_reach")
    closed = scan.running(opening, by, ["start0"], "_block", [("_next", "_reach", "min", "after")])
    last = df.where(F.col("end0") > F.col("start0")).groupBy(*by).agg(F.max("end0").alias("_last"))
    return closed.join(last, list(by)).select(*by, "start0", F.coalesce("_next", "_last").alias("end0"))


def complement_intervals(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Uncovered regions of [0, size) per chromosome of ``sizes``."""
    reach = _islands(df, ("chrom",))
    known = reach.join(sizes.select("chrom"), "chrom", "left_semi")
    gaps = known.select("chrom", F.coalesce("_reach", F.lit(0)).alias("gap0"), F.col("start0").alias("gap1"))
    last = df.where(F.col("end0") > F.col("start0")).groupBy("chrom").agg(F.max("end0").alias("_last"))
    tails = sizes.join(last, "chrom", "left").select("chrom", F.coalesce("_last", F.lit(0)).alias("gap0"), F.col("size").alias("gap1"))
    return gaps.unionByName(tails).where(F.col("gap1") > F.col("gap0")).select("chrom", F.col("gap0").alias("start0"), F.col("gap1").alias("end0"))


def coverage(df: DataFrame) -> DataFrame:
    """Run-length depth: maximal runs of constant depth above zero."""
    solid = df.where(F.col("end0") > F.col("start0"))
    steps = (
        solid.select("chrom", F.explode(F.array(F.struct(F.col("start0").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end0").alias("p"), F.lit(-1).alias("d")))).alias("e"))
        .groupBy("chrom", F.col("e.p").alias("start0"))
        .agg(F.sum("e.d").alias("_d"))
        .where(F.col("_d") != 0)
        .withColumn("_block", scan.width_block("start0", _SPAN))
    )
    swept = scan.running(steps, ["chrom"], ["start0"], "_block", [("depth", "_d", "sum", "upto"), ("end0", "start0", "min", "after")])
    return swept.where(F.col("depth") > 0).select("chrom", "start0", "end0", "depth")


def resize(df: DataFrame, width: int, fix: str = "start") -> DataFrame:
    """Fixed-width intervals anchored at start, end or center, strand aware."""
    minus = F.col("strand") == "-"
    from_left, from_right = F.col("start0"), F.col("end0") - width
    if fix == "center":
        start = F.floor((F.col("start0") + F.col("end0") - width) / 2)
    elif fix in ("start", "end"):
        lead = minus if fix == "start" else ~minus
        start = F.when(lead, from_right).otherwise(from_left)
    else:
        raise ValueError("fix must be start, end or center")
    return df.withColumn("_s", start).withColumn("start0", F.col("_s")).withColumn("end0", F.col("_s") + width).drop("_s")


def bounds_check(df: DataFrame, sizes: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("size").isNull(), "unknown chromosome")
        .when(F.col("start0") < 0, "start below zero")
        .when(F.col("end0") > F.col("size"), "end beyond chromosome")
        .when(F.col("end0") <= F.col("start0"), "empty")
        .otherwise("ok")
    )
    return df.join(sizes, "chrom", "left").withColumn("status", status).drop("size")


def transcript_positions(points: DataFrame, exons: DataFrame) -> DataFrame:
    """Map ``(tx, pos0)`` to transcript offset and, with ``cds_start``, to c. and p. places.

    ``exons`` has ``tx, start0, end0, strand`` and optionally ``cds_start`` (the
    zero-based transcript offset of the first coding base).  Minus-strand
    transcripts count from their right end.
    """
    order: Column = F.when(F.col("strand") == "-", -F.col("start0")).otherwise(F.col("start0"))
    # exons of one transcript: a bounded biological list
    w = Window.partitionBy("tx").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = exons.withColumn("_before", F.coalesce(F.sum(F.col("end0") - F.col("start0")).over(w), F.lit(0)))
    hit = points.join(placed, "tx").where((F.col("pos0") >= F.col("start0")) & (F.col("pos0") < F.col("end0")))
    inside = F.when(F.col("strand") == "-", F.col("end0") - 1 - F.col("pos0")).otherwise(F.col("pos0") - F.col("start0"))
    out = hit.withColumn("tx_offset", F.col("_before") + inside)
    cols = [*points.columns, "tx_offset"]
    if "cds_start" not in exons.columns:
        return out.select(*cols)
    out = out.withColumn("_c", F.col("tx_offset") - F.col("cds_start"))
    c_pos = F.when(F.col("_c") >= 0, F.col("_c") + 1).otherwise(F.col("_c"))
    coding = out.withColumn("cds_pos", c_pos)
    residue, frame = coordinates.protein_place(F.col("cds_pos"))
    return coding.select(
        *cols, "cds_pos", F.when(F.col("cds_pos") > 0, residue).alias("protein_pos"), F.when(F.col("cds_pos") > 0, frame).alias("codon_frame")
    )

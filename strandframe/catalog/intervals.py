"""Registered queries on intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog.base import query
from strandframe.functions import coordinates as C
from strandframe.operators import intervals


@query("coordinate_bases", """SELECT iv_id, start0 + 1 AS start1, end0 AS end1, (start0 + 1) - 1 AS back0, end0 - start0 AS length FROM ivals""", ["ivals"])
def _(x):
    one = x.ivals.select("iv_id", C.to_one_start(F.col("start0")).alias("start1"), F.col("end0").alias("end1"), (F.col("end0") - F.col("start0")).alias("length"))
    return one.withColumn("back0", C.to_zero_start(F.col("start1"), "gff"))


_PAIRS = "ivals a JOIN feats b ON a.chrom = b.chrom AND a.start0 < b.end0 AND b.start0 < a.end0 AND a.end0 > a.start0 AND b.end0 > b.start0"


@query(
    "find_overlaps",
    f"SELECT a.iv_id, b.feat_id, a.chrom, greatest(0, least(a.end0, b.end0) - greatest(a.start0, b.start0)) AS overlap FROM {_PAIRS}",
    ["ivals", "feats"],
)
def _(x):
    return intervals.find_overlaps(x.ivals, x.feats, "iv_id", "feat_id")


@query(
    "count_overlaps",
    f"""WITH n AS (SELECT a.iv_id, count(*) AS n FROM {_PAIRS} GROUP BY a.iv_id)
    SELECT ivals.iv_id, coalesce(n, 0) AS n_overlaps FROM ivals LEFT JOIN n USING (iv_id)""",
    ["ivals", "feats"],
)
def _(x):
    return intervals.count_overlaps(x.ivals, x.feats, "iv_id")


@query("subset_by_overlap", f"SELECT DISTINCT a.iv_id, a.chrom, a.start0, a.end0 FROM {_PAIRS}", ["ivals", "feats"])
def _(x):
    return intervals.subset_by_overlap(x.ivals, x.feats, "iv_id").select("iv_id", "chrom", "start0", "end0")


_MERGED = """m0 AS (SELECT chrom, start0, end0, max(end0) OVER (PARTITION BY chrom ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ivals),
    m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS g FROM m0),
    merged AS (SELECT chrom, min(start0) AS start0, max(end0) AS end0 FROM m1 GROUP BY chrom, g)"""


@query("merge_intervals", f"WITH {_MERGED} SELECT chrom, start0, end0 FROM merged", ["ivals"])
def _(x):
    return intervals.merge_intervals(x.ivals)


@query(
    "complement_intervals",
    f"""WITH {_MERGED}, g AS (SELECT chrom, coalesce(lag(end0) OVER (PARTITION BY chrom ORDER BY start0), 0) AS start0, start0 AS end0 FROM merged
    UNION ALL SELECT chrom, max(merged.end0), any_value(size) FROM merged JOIN chrom_sizes USING (chrom) GROUP BY chrom) SELECT * FROM g WHERE end0 > start0""",
    ["ivals", "chrom_sizes"],
)
def _(x):
    return intervals.complement_intervals(x.ivals, x.chrom_sizes)


@query(
    "coverage",
    """WITH e AS (SELECT chrom, start0 AS p, 1 AS d FROM ivals UNION ALL SELECT chrom, end0, -1 FROM ivals),
    s AS (SELECT chrom, p, sum(d) AS d FROM e GROUP BY ALL HAVING sum(d) <> 0),
    r AS (SELECT chrom, p AS start0, lead(p) OVER w AS end0, sum(d) OVER w AS depth FROM s WINDOW w AS (PARTITION BY chrom ORDER BY p))
    SELECT * FROM r WHERE depth > 0""",
    ["ivals"],
)
def _(x):
    return intervals.coverage(x.ivals)


@query(
    "resize_intervals",
    "SELECT iv_id, CASE WHEN strand = '-' THEN end0 - 25 ELSE start0 END AS start0, CASE WHEN strand = '-' THEN end0 ELSE start0 + 25 END AS end0 FROM ivals",
    ["ivals"],
)
def _(x):
    return intervals.resize(x.ivals, 25, "start").select("iv_id", "start0", "end0")


@query(
    "bounds_check",
    """SELECT feat_id, CASE WHEN size IS NULL THEN 'unknown chromosome' WHEN start0 < 0 THEN 'start below zero' WHEN end0 > size THEN 'end beyond chromosome'
    WHEN end0 <= start0 THEN 'empty' ELSE 'ok' END AS status FROM feats LEFT JOIN chrom_sizes USING (chrom)""",
    ["ivals", "chrom_sizes", "feats"],
)
def _(x):
    return intervals.bounds_check(x.feats, x.chrom_sizes).select("feat_id", "status")


@query("normalise_chromosomes", "SELECT c_custkey, concat('chr', CASE WHEN c_nationkey = 23 THEN 'M' ELSE c_nationkey::VARCHAR END) AS chrom FROM customer")
def _(x):
    raw = F.when(F.col("c_nationkey") == 23, "MT").otherwise(F.concat(F.when(F.col("c_custkey") % 2 == 0, "Chr").otherwise(""), F.col("c_nationkey")))
    return x.table("customer").select("c_custkey", C.plain_chromosome(raw).alias("chrom"))


@query(
    "transcript_positions",
    """WITH ex AS (SELECT l_orderkey AS tx, l_linenumber * 1000 + l_partkey % 500 AS start0, l_linenumber * 1000 + l_partkey % 500 + CAST(l_quantity AS INT) * 3 AS end0,
        CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem),
    e AS (SELECT DISTINCT * FROM ex QUALIFY row_number() OVER (PARTITION BY tx, start0 // 1000 ORDER BY start0, end0) = 1),
    b AS (SELECT *, coalesce(sum(end0 - start0) OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '-' THEN -start0 ELSE start0 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
    pts AS (SELECT DISTINCT l_orderkey AS tx, l_linenumber * 1000 + l_suppkey % 500 AS pos0 FROM lineitem),
    h AS (SELECT pts.tx, pos0, before + CASE WHEN strand = '-' THEN end0 - 1 - pos0 ELSE pos0 - start0 END AS tx_offset FROM pts JOIN b ON b.tx = pts.tx AND pos0 >= start0 AND pos0 < end0),
    c AS (SELECT *, CASE WHEN tx_offset >= 10 THEN tx_offset - 10 + 1 ELSE tx_offset - 10 END AS cds_pos FROM h)
    SELECT *, CASE WHEN cds_pos > 0 THEN (cds_pos - 1) // 3 + 1 END AS protein_pos, CASE WHEN cds_pos > 0 THEN (cds_pos - 1) % 3 END AS codon_frame FROM c""",
)
def _(x):
    li = x.table("lineitem")
    start = F.col("l_linenumber") * 1000 + F.col("l_partkey") % 500
    exons = (
        li.select(F.col("l_orderkey").alias("tx"), "l_linenumber", start.alias("start0"), (start + F.col("l_quantity").cast("int") * 3).alias("end0"))
        .groupBy("tx", "l_linenumber")
        .agg(F.min(F.struct("start0", "end0")).alias("e"))
        .select("tx", "e.start0", "e.end0", F.when(F.col("tx") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(10).alias("cds_start"))
    )
    points = li.select(F.col("l_orderkey").alias("tx"), (F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 500).alias("pos0")).distinct()
    return intervals.transcript_positions(points, exons)

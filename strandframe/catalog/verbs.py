"""Registered queries on general table verbs and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog.base import query
from strandframe.operators import expression, restriction, verbs


@query("select_numeric", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def _(x):
    return verbs.numeric_columns(x.table("lineitem"))


@query("keep_first", "SELECT gene, sample, n FROM counts QUALIFY row_number() OVER (PARTITION BY gene ORDER BY n, sample) = 1", ["counts"])
def _(x):
    return verbs.keep_first(x.counts, ["gene"], ["n", "sample"])


@query("crosstab", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def _(x):
    return verbs.crosstab(x.table("orders"), "o_orderpriority", "o_orderstatus")


@query("pivot_longer", "SELECT p_partkey AS gene, 'p_size' AS sample, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def _(x):
    p = x.table("part").select(F.col("p_partkey").alias("gene"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return p.unpivot("gene", ["p_size", "p_retailprice"], "sample", "value")


@query("transpose", "SELECT gene AS sample, sample AS gene, n FROM counts", ["counts"])
def _(x):
    return verbs.transpose_long(x.counts)


@query(
    "fill_median",
    """WITH j AS (SELECT doc_id, quality::DOUBLE AS quality, CASE WHEN n_chars > 300 THEN n_chars::DOUBLE END AS n FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, coalesce(quality, (SELECT quantile_cont(quality, 0.5) FROM j)) AS quality, round(coalesce(n, (SELECT quantile_cont(n, 0.5) FROM j)), 6) AS n FROM j""",
)
def _(x):
    j = x.table("documents").select("doc_id", F.when(F.col("n_chars") > 300, F.col("n_chars").cast("double")).alias("n")).join(x.table("labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id", "left")
    return verbs.fill_median(j, ["quality", "n"])


@query("level_order", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 END AS level FROM orders")
def _(x):
    return verbs.level_order(x.table("orders"), "o_orderstatus", ["O", "P"]).select("o_orderkey", "level")


@query(
    "invalid_letters",
    "WITH c AS (SELECT DISTINCT seq_id, unnest(string_split(seq, '')) AS ch FROM prots WHERE length(seq) > 0) SELECT seq_id, coalesce(string_agg(ch, '' ORDER BY ch) FILTER (ch NOT IN ('A','C','G','T','N')), '') AS bad FROM c GROUP BY seq_id",
    ["prots"],
)
def _(x):
    return x.prots.where("length(seq) > 0").select("seq_id", verbs.invalid_letters(F.col("seq"), "ACGTN").alias("bad"))


@query("species_directory", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'homo_sapiens' WHEN 'MACHINERY' THEN 'mus_musculus' ELSE lower(c_mktsegment) END AS dir FROM customer")
def _(x):
    seg = F.col("c_mktsegment")
    return x.table("customer").select("c_custkey", verbs.species_directory(F.when(seg == "BUILDING", "Human").when(seg == "MACHINERY", " mouse").otherwise(seg)).alias("dir"))


@query("attach_groups", "SELECT gene, sample, n, condition FROM counts LEFT JOIN meta USING (sample)", ["counts", "meta"])
def _(x):
    return x.counts.join(x.meta.select("sample", "condition"), "sample", "left").select("gene", "sample", "n", "condition")


@query("align_samples", "SELECT gene, sample, n, batch FROM counts JOIN meta USING (sample)", ["counts", "meta"])
def _(x):
    return expression.align_samples(x.counts, x.meta).select("gene", "sample", "n", "batch")


@query("listed_genes", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')")
def _(x):
    return x.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(x.table("part").where("p_type = 'PROMO'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")


@query("unmatched_genes", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(x):
    return x.table("part").select("p_partkey").join(x.table("lineitem").where("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")


@query(
    "missing_enzymes",
    "SELECT DISTINCT p_brand AS enzyme FROM part UNION SELECT 'NoSuchI' AS enzyme",
)
def _(x):
    asked = x.table("part").select(F.explode(F.array(F.col("p_brand"), F.lit("EcoRI"), F.lit("NoSuchI"))).alias("enzyme"))
    return restriction.missing_enzymes(asked)


@query("zero_grid", "SELECT gene, sample, coalesce(n, 0) AS n FROM (SELECT DISTINCT gene FROM counts) CROSS JOIN (SELECT DISTINCT sample FROM counts) LEFT JOIN counts USING (gene, sample)", ["counts"])
def _(x):
    return verbs.zero_grid(x.counts, "gene", "sample", "n")


@query("consecutive_gap", "SELECT chrom, start0, lead(start0) OVER (PARTITION BY chrom ORDER BY start0) - start0 AS gap FROM (SELECT DISTINCT chrom, start0 FROM ivals) t", ["ivals"])
def _(x):
    return verbs.consecutive_gap(x.ivals, "chrom", "start0")


@query("best_rows", "SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 2")
def _(x):
    return verbs.best_rows(x.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", [F.desc("l_extendedprice"), F.asc("l_linenumber")], 2)

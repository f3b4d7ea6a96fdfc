"""Derived inputs: sequences, intervals, counts and so on from the given tables.

Each view is defined twice, as a DataFrame for Spark and as plain SQL for the
comparison, and always covers the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.plans.storage import spread

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO_DNA = "ACGTACGTACGTACGTACGTACGTAC"
_TO_PROTEIN = "ANCDEFGHIKKLMNPPQRSTVVWAYG"


def _sequence_column(text, target: str):
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), _LETTERS, target)


class Inputs:
    """Lazily built DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def seqs(self) -> DataFrame:
        return spread(self.table("documents").select("doc_id", "source", "text")).select(
            F.col("doc_id").alias("seq_id"), F.col("source").alias("description"), _sequence_column("text", _TO_DNA).alias("seq")
        )

    @cached_property
    def prots(self) -> DataFrame:
        return spread(self.table("documents").select("doc_id", "text")).select(F.col("doc_id").alias("seq_id"), _sequence_column("text", _TO_PROTEIN).alias("seq"))

    @cached_property
    def turns(self) -> DataFrame:
        return spread(self.table("conversations").select("conv_id", "turn", "text")).select(
            F.col("conv_id").alias("construct"), F.col("turn").alias("ord"), _sequence_column("text", _TO_DNA).alias("seq")
        )

    @cached_property
    def msa(self) -> DataFrame:
        letter = lambda v: (
            F.when(v < -0.125, "A").when(v < 0, "C").when(v < 0.125, "G").when(v < 0.25, "T").otherwise("-")
        )
        return self.table("embeddings").select(
            F.col("label").alias("aln_id"), F.col("vec_id").alias("seq_id"), F.array_join(F.transform("embedding", letter), "").alias("aligned")
        )

    @cached_property
    def counts(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("gene"), (F.col("l_suppkey") % 6).alias("sample"))
            .agg(F.sum("l_quantity").cast("long").alias("n"))
        )

    @cached_property
    def meta(self) -> DataFrame:
        return (
            self.table("lineitem")
            .select((F.col("l_suppkey") % 6).alias("sample"))
            .distinct()
            .select("sample", F.when(F.col("sample") < 3, "ctrl").otherwise("trt").alias("condition"), F.when(F.col("sample") % 2 == 0, "b0").otherwise("b1").alias("batch"))
        )

    @cached_property
    def ranks(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("gene"))
            .agg(F.sum(F.when(F.col("l_suppkey") % 6 >= 3, F.col("l_quantity")).otherwise(-F.col("l_quantity"))).alias("stat"))
        )

    @cached_property
    def gene_sets(self) -> DataFrame:
        part = self.table("part")
        return part.select(F.col("p_brand").alias("gs_name"), F.col("p_partkey").alias("gene")).unionAll(
            part.select(F.col("p_type").alias("gs_name"), F.col("p_partkey").alias("gene"))
        )

    @cached_property
    def otu(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy((F.col("l_suppkey") % 20).alias("sample"), (F.col("l_partkey") % 50).alias("otu"))
            .agg(F.sum("l_quantity").cast("long").alias("abundance"))
        )

    @cached_property
    def ivals(self) -> DataFrame:
        start = F.floor(F.col("value") * 100).cast("long") + F.col("user_id") * 100000
        return self.table("events").select(
            F.col("event_id").alias("iv_id"),
            F.col("event_type").alias("chrom"),
            start.alias("start0"),
            (start + 1 + F.col("user_id") % 40).alias("end0"),
            F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"),
        )

    @cached_property
    def feats(self) -> DataFrame:
        start = F.floor(F.abs("c_acctbal") * 5).cast("long") + F.floor(F.col("c_custkey") / 10).cast("long") * 100000
        return self.table("customer").select(
            F.col("c_custkey").alias("feat_id"),
            F.element_at(F.array(*[F.lit(x) for x in ("view", "click", "purchase", "error", "signup")]), F.col("c_nationkey") % 5 + 1).alias("chrom"),
            start.alias("start0"),
            (start + 1 + F.col("c_nationkey") * 150).alias("end0"),
            F.when(F.col("c_custkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        )

    @cached_property
    def chrom_sizes(self) -> DataFrame:
        return self.ivals.groupBy("chrom").agg((F.max("end0") + 100).alias("size"))

    @cached_property
    def variants(self) -> DataFrame:
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("var_id"),
            F.col("l_returnflag").alias("chrom"),
            F.col("l_partkey").alias("pos"),
            F.expr("substr('ACGTACGT', 1 + CAST(l_partkey % 4 AS INT), 1 + CAST(l_linenumber % 3 AS INT))").alias("ref"),
            F.expr("substr('CGTACGTA', 1 + CAST(l_partkey % 4 AS INT), 1 + CAST(l_suppkey % 3 AS INT))").alias("alt"),
            F.col("l_quantity").alias("qual"),
            F.col("l_discount").alias("maf"),
        )

    @cached_property
    def genotypes(self) -> DataFrame:
        return self.table("customer").select(
            F.explode(F.sequence(F.lit(1), F.lit(7))).alias("locus"), "*"
        ).select(
            "locus",
            F.col("c_custkey").alias("individual"),
            F.col("c_mktsegment").alias("population"),
            ((F.col("c_custkey") * 7 + F.col("locus") * 3 + F.col("c_nationkey") * F.col("locus")) % 3).alias("gt"),
        )

    @cached_property
    def survival(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("subject"),
            F.col("o_orderpriority").alias("grp"),
            (F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")) + 1).alias("time"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("event"),
            (F.col("o_totalprice") / 100000).alias("x1"),
            (F.col("o_custkey") % 5).cast("double").alias("x2"),
        )

    @cached_property
    def tree(self) -> DataFrame:
        region, nation, customer = self.table("region"), self.table("nation"), self.table("customer")
        region_rows = region.select(
            F.concat(F.lit("r"), F.col("r_regionkey")).alias("child"), F.lit("root").alias("parent"), (F.lit(1.0) + F.col("r_regionkey")).alias("blen")
        )
        nation_rows = nation.select(
            F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"),
            F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"),
            (F.lit(0.5) * (1 + F.col("n_nationkey") % 4)).alias("blen"),
        )
        customer_rows = customer.select(
            F.concat(F.lit("c"), F.col("c_custkey")).alias("child"),
            F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"),
            (F.lit(0.25) * (1 + F.col("c_custkey") % 8)).alias("blen"),
        )
        return region_rows.unionAll(nation_rows).unionAll(customer_rows).select(F.lit("t1").alias("tree_id"), "*")

    @cached_property
    def atoms(self) -> DataFrame:
        xyz = [(F.get("embedding", F.lit(i)).cast("double") * 20).alias(n) for i, n in enumerate("xyz")]
        return self.table("embeddings").select(
            F.floor(F.col("vec_id") / 100).cast("long").alias("struct_id"),
            F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("label") % 4 + 1).cast("int")).alias("chain"),
            (F.col("vec_id") % 100).alias("resseq"),
            F.element_at(F.array(*[F.lit(x) for x in ("ALA", "GLY", "LYS", "TRP", "HOH")]), (F.col("vec_id") % 5 + 1).cast("int")).alias("resname"),
            F.lit("CA").alias("atom"),
            *xyz,
        )

    @cached_property
    def hsps(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("query"),
            F.col("l_partkey").alias("hit"),
            (F.col("l_extendedprice") / 1e6 * F.col("l_discount")).alias("evalue"),
            F.col("l_quantity").alias("identities"),
            F.lit(50).alias("align_len"),
            F.col("l_extendedprice").alias("score"),
        )

    @cached_property
    def features(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("plasmid_id"),
            F.concat(F.lit("f"), F.col("l_linenumber")).alias("name"),
            (F.col("l_linenumber") * 100).alias("fstart"),
            (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")).alias("fend"),
            F.col("l_returnflag").alias("ftype"),
            F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("direction"),
        )

    @cached_property
    def oplog(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            "ts",
            F.col("event_type").alias("op"),
            (F.col("event_type") != "error").alias("ok"),
            F.col("value").alias("duration_ms"),
            F.col("user_id").alias("signature"),
            "props",
        )


def _seq_sql(column: str, target: str) -> str:
    return f"translate(upper(regexp_replace({column}, '[^A-Za-z]', '', 'g')), '{_LETTERS}', '{target}')"


SQL_VIEWS: dict[str, str] = {
    "seqs": f"SELECT doc_id AS seq_id, source AS description, {_seq_sql('text', _TO_DNA)} AS seq FROM documents",
    "prots": f"SELECT doc_id AS seq_id, {_seq_sql('text', _TO_PROTEIN)} AS seq FROM documents",
    "turns": f"SELECT conv_id AS construct, turn AS ord, {_seq_sql('text', _TO_DNA)} AS seq FROM conversations",
    "msa": """SELECT label AS aln_id, vec_id AS seq_id, array_to_string(list_transform(embedding, lambda v:
        CASE WHEN v::DOUBLE < -0.125::DOUBLE THEN 'A' WHEN v::DOUBLE < 0 THEN 'C' WHEN v::DOUBLE < 0.125::DOUBLE THEN 'G'
             WHEN v::DOUBLE < 0.25::DOUBLE THEN 'T' ELSE '-' END), '') AS aligned FROM embeddings""",
    "counts": "SELECT l_partkey AS gene, l_suppkey % 6 AS sample, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL",
    "meta": """SELECT sample, CASE WHEN sample < 3 THEN 'ctrl' ELSE 'trt' END AS condition,
        CASE WHEN sample % 2 = 0 THEN 'b0' ELSE 'b1' END AS batch FROM (SELECT DISTINCT l_suppkey % 6 AS sample FROM lineitem) t""",
    "ranks": "SELECT l_partkey AS gene, sum(CASE WHEN l_suppkey % 6 >= 3 THEN l_quantity ELSE -l_quantity END) AS stat FROM lineitem GROUP BY l_partkey",
    "gene_sets": "SELECT p_brand AS gs_name, p_partkey AS gene FROM part UNION ALL SELECT p_type, p_partkey FROM part",
    "otu": "SELECT l_suppkey % 20 AS sample, l_partkey % 50 AS otu, CAST(sum(l_quantity) AS BIGINT) AS abundance FROM lineitem GROUP BY ALL",
    "ivals": """SELECT event_id AS iv_id, event_type AS chrom, CAST(floor(value * 100) AS BIGINT) + user_id * 100000 AS start0,
        CAST(floor(value * 100) AS BIGINT) + user_id * 100000 + 1 + user_id % 40 AS end0,
        CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM events""",
    "feats": """SELECT c_custkey AS feat_id, (['view','click','purchase','error','signup'])[c_nationkey % 5 + 1] AS chrom,
        CAST(floor(abs(c_acctbal) * 5) AS BIGINT) + (c_custkey // 10) * 100000 AS start0,
        CAST(floor(abs(c_acctbal) * 5) AS BIGINT) + (c_custkey // 10) * 100000 + 1 + c_nationkey * 150 AS end0,
        CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM customer""",
    "chrom_sizes": "SELECT chrom, max(end0) + 100 AS size FROM ivals GROUP BY chrom",
    "variants": """SELECT l_orderkey * 10 + l_linenumber AS var_id, l_returnflag AS chrom, l_partkey AS pos,
        substr('ACGTACGT', 1 + CAST(l_partkey % 4 AS INT), 1 + CAST(l_linenumber % 3 AS INT)) AS ref,
        substr('CGTACGTA', 1 + CAST(l_partkey % 4 AS INT), 1 + CAST(l_suppkey % 3 AS INT)) AS alt,
        l_quantity AS qual, l_discount AS maf FROM lineitem""",
    "genotypes": """SELECT locus, c_custkey AS individual, c_mktsegment AS population,
        (c_custkey * 7 + locus * 3 + c_nationkey * locus) % 3 AS gt FROM customer, (SELECT unnest(range(1, 8)) AS locus) l""",
    "survival": """SELECT o_orderkey AS subject, o_orderpriority AS grp,
        date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 1 AS time,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event, o_totalprice / 100000 AS x1, CAST(o_custkey % 5 AS DOUBLE) AS x2 FROM orders""",
    "tree": """SELECT 't1' AS tree_id, * FROM (SELECT concat('r', r_regionkey) AS child, 'root' AS parent, 1.0::DOUBLE + r_regionkey AS blen FROM region
        UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 0.5::DOUBLE * (1 + n_nationkey % 4) FROM nation
        UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 0.25::DOUBLE * (1 + c_custkey % 8) FROM customer) t""",
    "atoms": """SELECT vec_id // 100 AS struct_id, (['A','B','C','D'])[label % 4 + 1] AS chain, vec_id % 100 AS resseq,
        (['ALA','GLY','LYS','TRP','HOH'])[vec_id % 5 + 1] AS resname, 'CA' AS atom,
        CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y, CAST(embedding[3] AS DOUBLE) * 20 AS z FROM embeddings""",
    "hsps": """SELECT l_orderkey AS query, l_partkey AS hit, l_extendedprice / 1e6 * l_discount AS evalue, l_quantity AS identities,
        50 AS align_len, l_extendedprice AS score FROM lineitem""",
    "features": """SELECT l_orderkey AS plasmid_id, concat('f', l_linenumber) AS name, l_linenumber * 100 AS fstart,
        l_linenumber * 100 + CAST(l_quantity AS INT) AS fend, l_returnflag AS ftype,
        CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS direction FROM lineitem""",
    "oplog": """SELECT event_id, ts, event_type AS op, event_type <> 'error' AS ok, value AS duration_ms, user_id AS signature, props FROM events""",
}

_NEEDS = {"chrom_sizes": ("ivals",)}


def with_views(names: Sequence[str], body: str) -> str:
    """Prefix ``body`` with the named views as CTEs."""
    wanted: list[str] = []
    for name in names:
        for dep in (*_NEEDS.get(name, ()), name):
            if dep not in wanted:
                wanted.append(dep)
    ctes = [f"{n} AS ({SQL_VIEWS[n]})" for n in wanted]
    text = body.strip()
    if text.upper().startswith("WITH "):
        ctes.append(text[5:])
        return "WITH RECURSIVE " + ",\n".join(ctes)
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + text

"""Registered queries on structures and search hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog.base import query
from strandframe.operators import structure as R

_D = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


@query("atom_distance", f"SELECT a.struct_id, a.chain AS chain_a, a.resseq AS res_a, b.chain AS chain_b, b.resseq AS res_b, round({_D}, 6) AS distance FROM atoms a JOIN atoms b ON a.struct_id = b.struct_id AND b.resseq = a.resseq + 1", ["atoms"])
def _(x):
    a = x.atoms.select("struct_id", F.col("chain").alias("chain_a"), F.col("resseq").alias("res_a"))
    b = x.atoms.select("struct_id", F.col("chain").alias("chain_b"), F.col("resseq").alias("res_b"))
    pairs = a.withColumn("res_b", F.col("res_a") + 1).join(b, ["struct_id", "res_b"])
    return R.atom_distance(x.atoms, pairs).withColumn("distance", F.round("distance", 6))


@query(
    "neighbours",
    f"""SELECT a.struct_id, a.resseq AS centre_id, b.chain, b.resseq, b.resname, round({_D}, 6) AS distance FROM atoms a JOIN atoms b ON a.struct_id = b.struct_id WHERE {_D} < 2.5 AND b.resname <> 'HOH'""",
    ["atoms"],
)
def _(x):
    centres = x.atoms.select("struct_id", F.col("resseq").alias("centre_id"), "x", "y", "z")
    return R.neighbours(x.atoms, centres, 2.5).withColumn("distance", F.round("distance", 6))


@query(
    "chain_interface",
    f"""SELECT a.struct_id, a.chain AS chain_a, a.resseq AS res_a, b.chain AS chain_b, b.resseq AS res_b, round(min({_D}), 6) AS distance FROM atoms a JOIN atoms b ON a.struct_id = b.struct_id AND a.chain < b.chain
    WHERE {_D} < 1.5 AND a.resname <> 'HOH' AND b.resname <> 'HOH' GROUP BY ALL""",
    ["atoms"],
)
def _(x):
    return R.chain_interface(x.atoms, 1.5).withColumn("distance", F.round("distance", 6))


@query("superpose_rmsd")
def _(x):
    ids = x.atoms.select(F.col("struct_id").alias("a")).distinct()
    pairs = ids.select("a", (F.col("a") + 1).alias("b")).join(ids.select(F.col("a").alias("b")), "b")
    return R.superpose_rmsd(x.atoms, pairs).select("a", "b", "n_atoms", "rmsd")


@query(
    "structure_sequence",
    """SELECT struct_id, chain, string_agg(CASE resname WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' WHEN 'LYS' THEN 'K' WHEN 'TRP' THEN 'W' END, '' ORDER BY resseq) AS sequence FROM atoms WHERE resname <> 'HOH' GROUP BY ALL""",
    ["atoms"],
)
def _(x):
    return R.structure_sequence(x.atoms)


@query(
    "secondary_structure",
    """WITH r AS (SELECT DISTINCT struct_id, chain, resseq FROM atoms WHERE resname <> 'HOH'), rec AS (SELECT struct_id, chain, resseq AS s, resseq + 6 AS e, CASE WHEN resname = 'ALA' THEN 'helix' ELSE 'sheet' END AS kind FROM atoms WHERE resname IN ('ALA', 'GLY')),
    k AS (SELECT r.*, coalesce(min(kind), 'coil') AS kind FROM r LEFT JOIN rec ON rec.struct_id = r.struct_id AND rec.chain = r.chain AND resseq BETWEEN s AND e GROUP BY ALL)
    SELECT struct_id, kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY struct_id), 6) AS share FROM k GROUP BY struct_id, kind""",
    ["atoms"],
)
def _(x):
    rec = x.atoms.where("resname IN ('ALA', 'GLY')").select("struct_id", "chain", F.col("resseq").alias("start"), (F.col("resseq") + 6).alias("end"), F.when(F.col("resname") == "ALA", "helix").otherwise("sheet").alias("kind"))
    return R.secondary_structure_composition(x.atoms, rec).withColumn("share", F.round("share", 6))


_BEST = "bh AS (SELECT query, hit, evalue, score, round(identities / align_len * 100, 1) AS identity_pct FROM hsps QUALIFY row_number() OVER (PARTITION BY query, hit ORDER BY evalue, score DESC, identities, align_len) = 1)"


@query("best_hsp", f"WITH {_BEST} SELECT query, hit, round(evalue, 9) AS evalue, score, identity_pct FROM bh", ["hsps"])
def _(x):
    return R.best_hsp(x.hsps).withColumn("evalue", F.round("evalue", 9))


@query("filter_hits", "SELECT query, hit, score FROM hsps WHERE evalue < 1e-10 AND identities / align_len * 100 >= 70", ["hsps"])
def _(x):
    return R.filter_hits(x.hsps).select("query", "hit", "score")


@query("top_hits", f"WITH {_BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY evalue, score DESC, hit) AS rank FROM bh) SELECT query, hit, round(evalue, 9) AS evalue, score, identity_pct, rank FROM r WHERE rank <= 3", ["hsps"])
def _(x):
    return R.top_hits(x.hsps, 3).withColumn("evalue", F.round("evalue", 9))


@query(
    "suspicious_hits",
    "SELECT l_orderkey AS query, l_partkey AS hit, concat(CASE l_returnflag WHEN 'N' THEN 'Uncultured ' WHEN 'A' THEN 'cloning vector ' ELSE 'strain ' END, l_suppkey) AS description FROM lineitem WHERE l_returnflag IN ('N', 'A')",
)
def _(x):
    text = F.concat(F.when(F.col("l_returnflag") == "N", "Uncultured ").when(F.col("l_returnflag") == "A", "cloning vector ").otherwise("strain "), F.col("l_suppkey"))
    return R.suspicious_hits(x.table("lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("hit"), text.alias("description")))

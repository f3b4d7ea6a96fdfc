"""Structures as flat atom rows (struct_id, chain, resseq, resname, atom, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import dna

# Residue names that are solvent, not chain members.
SOLVENT = ("HOH", "WAT", "DOD")


def _distance(p: str, q: str) -> Column:
    return F.sqrt(sum((F.col(f"{p}.{a}") - F.col(f"{q}.{a}")) ** 2 for a in "xyz"))


def atom_distance(atoms: DataFrame, pairs: DataFrame, atom: str = "CA") -> DataFrame:
    """Distance between named atoms of residue pairs (struct_id, chain_a, res_a, chain_b, res_b)."""
    own = atoms.where(F.col("atom") == atom)
    side = lambda s: own.select("struct_id", F.col("chain").alias(f"chain_{s}"), F.col("resseq").alias(f"res_{s}"), F.struct("x", "y", "z").alias(f"_{s}"))
    j = pairs.join(side("a"), ["struct_id", "chain_a", "res_a"]).join(side("b"), ["struct_id", "chain_b", "res_b"])
    return j.select("struct_id", "chain_a", "res_a", "chain_b", "res_b", _distance("_a", "_b").alias("distance"))


def _close_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Rows of ``left`` and ``right`` (struct_id, p, ...) nearer than ``radius``.

    Space is cut into cubes of the radius; each left row visits its own and the
    26 neighbouring cubes, so only nearby atoms meet.
    """
    cell = lambda a: F.floor(F.col(f"p.{a}") / radius).cast("long")
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    spread = (
        left.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumn("_dz", F.explode(steps))
        .withColumn("_cx", cell("x") + F.col("_dx")).withColumn("_cy", cell("y") + F.col("_dy")).withColumn("_cz", cell("z") + F.col("_dz"))
        .drop("_dx", "_dy", "_dz")
    )
    placed = right.select("*", cell("x").alias("_cx"), cell("y").alias("_cy"), cell("z").alias("_cz")).withColumnRenamed("p", "q")
    return spread.join(placed, ["struct_id", "_cx", "_cy", "_cz"]).withColumn("distance", _distance("p", "q")).where(F.col("distance") < radius)


def neighbours(atoms: DataFrame, centres: DataFrame, radius: float = 5.0) -> DataFrame:
    """Residues whose CA lies nearer than ``radius`` to a centre (solvent left out)."""
    ca = atoms.where((F.col("atom") == "CA") & ~F.col("resname").isin(*SOLVENT))
    left = centres.select("struct_id", "centre_id", F.struct("x", "y", "z").alias("p"))
    right = ca.select("struct_id", "chain", "resseq", "resname", F.struct("x", "y", "z").alias("p"))
    return _close_pairs(left, right, radius).select("struct_id", "centre_id", "chain", "resseq", "resname", "distance")


def chain_interface(atoms: DataFrame, cutoff: float = 3.5) -> DataFrame:
    """Residue pairs of different chains with any atoms nearer than the cut-off."""
    solid = atoms.where(~F.col("resname").isin(*SOLVENT))
    side = lambda s: solid.select("struct_id", F.col("chain").alias(f"chain_{s}"), F.col("resseq").alias(f"res_{s}"), F.struct("x", "y", "z").alias("p"))
    near = _close_pairs(side("a"), side("b"), cutoff).where(F.col("chain_a") < F.col("chain_b"))
    return near.groupBy("struct_id", "chain_a", "res_a", "chain_b", "res_b").agg(F.min("distance").alias("distance"))


def superpose_rmsd(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Least-squares superposition (Kabsch 1976) of CA atoms in residue order.

    The first n CA atoms of both structures correspond.  Centroids and the
    3 x 3 covariance are aggregates; the nine sums per pair are solved in Arrow
    batches into RMSD, rotation and translation.
    """
    order = Window.partitionBy("struct_id").orderBy("chain", "resseq")  # atoms of one structure
    ca = atoms.where(F.col("atom") == "CA").withColumn("_i", F.row_number().over(order))
    side = lambda s: ca.select(F.col("struct_id").alias(s), "_i", *[F.col(a).alias(f"{a}_{s}") for a in "xyz"])
    matched = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "_i"])
    axes = "xyz"
    sums = matched.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(f"{u}_a") for u in axes]).alias("sa"), F.array(*[F.sum(f"{u}_b") for u in axes]).alias("sb"),
        F.array(*[F.sum(F.col(f"{u}_a") * F.col(f"{v}_b")) for u in axes for v in axes]).alias("sab"),
        F.sum(sum(F.col(f"{u}_a") ** 2 for u in axes)).alias("saa"), F.sum(sum(F.col(f"{u}_b") ** 2 for u in axes)).alias("sbb"),
    )

    def solve(batches):
        import numpy as np
        import pandas as pd

        for g in batches:
            rows = []
            for a, b, n, sa, sb, sab, saa, sbb in g[["a", "b", "n", "sa", "sb", "sab", "saa", "sbb"]].itertuples(index=False):
                ma, mb = np.asarray(sa) / n, np.asarray(sb) / n
                cov = np.asarray(sab).reshape(3, 3) - n * np.outer(ma, mb)
                u, s, vt = np.linalg.svd(cov)
                sign = np.sign(np.linalg.det(u) * np.linalg.det(vt))
                turn = u @ np.diag([1.0, 1.0, sign]) @ vt
                spread = saa - n * ma @ ma + sbb - n * mb @ mb
                rmsd = np.sqrt(max(spread - 2 * (s[0] + s[1] + sign * s[2]), 0.0) / n)
                rows.append((a, b, n, float(rmsd), turn.ravel().tolist(), (ma - turn @ mb).tolist()))
            yield pd.DataFrame(rows, columns=["a", "b", "n_atoms", "rmsd", "rotation", "translation"])

    kind = dict(atoms.dtypes)["struct_id"]
    return sums.mapInPandas(solve, f"a {kind}, b {kind}, n_atoms long, rmsd double, rotation array<double>, translation array<double>")


def structure_sequence(atoms: DataFrame) -> DataFrame:
    """One-letter sequence of every chain in residue order (solvent left out)."""
    ca = atoms.where((F.col("atom") == "CA") & ~F.col("resname").isin(*SOLVENT))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("resseq", "resname"))), lambda s: s["resname"])
    return ca.groupBy("struct_id", "chain").agg(F.array_join(ordered, "").alias("_three")).select("struct_id", "chain", dna.to_one_letter("_three").alias("sequence"))


def secondary_structure_composition(atoms: DataFrame, records: DataFrame) -> DataFrame:
    """Share of residues in helix, sheet and coil from records (struct_id, chain, start, end, kind).

    A residue in several records counts once, helix before sheet.
    """
    residues = atoms.where(~F.col("resname").isin(*SOLVENT)).select("struct_id", "chain", "resseq").distinct()
    hit = residues.join(records, ["struct_id", "chain"]).where(F.col("resseq").between(F.col("start"), F.col("end")))
    named = hit.groupBy("struct_id", "chain", "resseq").agg(F.min("kind").alias("kind"))
    full = residues.join(named, ["struct_id", "chain", "resseq"], "left").withColumn("kind", F.coalesce("kind", F.lit("coil")))
    per = full.groupBy("struct_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("struct_id").agg(F.sum("n").alias("_t"))
    return per.join(total, "struct_id").select("struct_id", "kind", "n", (F.col("n") / F.col("_t")).alias("share"))


def best_hsp(hits: DataFrame) -> DataFrame:
    """Best segment per query and hit (lowest e-value, then highest score)."""
    best = hits.groupBy("query", "hit").agg(F.min(F.struct("evalue", (-F.col("score")).alias("neg"), "identities", "align_len")).alias("b"))
    return best.select("query", "hit", F.col("b.evalue").alias("evalue"), (-F.col("b.neg")).alias("score"), F.round(F.col("b.identities") / F.col("b.align_len") * 100, 1).alias("identity_pct"))


def filter_hits(hits: DataFrame, max_evalue: float = 1e-10, min_identity: float = 70.0) -> DataFrame:
    """Segments below the e-value and at or above the identity, in percent."""
    return hits.where((F.col("evalue") < max_evalue) & (F.col("identities") / F.col("align_len") * 100 >= min_identity))


def top_hits(hits: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best hits per query by their best segment."""
    order = Window.partitionBy("query").orderBy("evalue", F.desc("score"), "hit")
    return best_hsp(hits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def suspicious_hits(hits: DataFrame, words: tuple[str, ...] = ("uncultured", "environmental", "vector")) -> DataFrame:
    """Hits whose description names an uncultured, environmental or vector source."""
    return hits.where(F.lower("description").rlike("|".join(words)))

"""Codon usage, adaptation index, host optimisation and rare-codon clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import dna
from strandframe.functions import tables as T
from strandframe.plans import scan, tiles


def codon_rows(df: DataFrame) -> DataFrame:
    """One row per in-frame codon with its zero-based index ``i``."""
    width = 3 * 1365
    cut = tiles.tile_rows(df.select("seq_id", F.translate(F.upper("seq"), "U", "T").alias("seq")), width=width)
    return cut.select("seq_id", "tile_start0", F.posexplode(dna.codons("tile")).alias("_i", "codon")).select(
        "seq_id", (F.col("tile_start0") / 3 + F.col("_i")).cast("long").alias("i"), "codon"
    )


def _code_table(spark, table: int) -> DataFrame:
    # 64 rows by construction
    return spark.createDataFrame(sorted(T.codon_amino(table).items()), "codon string, aa string")


def codon_usage(df: DataFrame, table: int = 1) -> DataFrame:
    """Count of every codon, its share of all codons and within its residue."""
    counted = codon_rows(df).groupBy("codon").agg(F.count(F.lit(1)).alias("n"))
    named = counted.join(F.broadcast(_code_table(df.sparkSession, table)), "codon")
    # at most 64 rows are left here
    everything = Window.partitionBy(F.lit(0))
    return named.select(
        "codon",
        "aa",
        "n",
        F.round(F.col("n") / F.sum("n").over(everything), 6).alias("share"),
        F.round(F.col("n") / F.sum("n").over(Window.partitionBy("aa")), 6).alias("share_in_aa"),
    )


def adaptation_index(df: DataFrame, reference: DataFrame, table: int = 1) -> DataFrame:
    """Codon adaptation index per sequence (Sharp and Li 1987).

    Geometric mean of each codon's count relative to the best codon of its
    residue in ``reference``; unseen codons count 0.5; stops and the
    single-codon residues M and W are left out.
    """
    code = _code_table(df.sparkSession, table)
    seen = codon_rows(reference).groupBy("codon").agg(F.count(F.lit(1)).cast("double").alias("n"))
    weights = (
        code.join(seen, "codon", "left")
        .withColumn("n", F.coalesce("n", F.lit(0.5)))
        .withColumn("w", F.col("n") / F.max("n").over(Window.partitionBy("aa")))
        .where(~F.col("aa").isin("*", "M", "W"))
        .select("codon", F.log("w").alias("lw"))
    )
    used = codon_rows(df).groupBy("seq_id", "codon").agg(F.count(F.lit(1)).alias("n"))
    return (
        used.join(F.broadcast(weights), "codon")
        .groupBy("seq_id")
        .agg(F.round(F.exp(F.sum(F.col("n") * F.col("lw")) / F.sum("n")), 6).alias("cai"), F.sum("n").alias("n_codons"))
    )


def codon_optimize(df: DataFrame, organism: str = "ecoli") -> DataFrame:
    """Back-translate with the best codon of the host.

    Stops become TAA, undetermined residues NNN; neither counts as a change.
    """
    if organism not in T.HOST_CODONS:
        raise ValueError(f"unknown organism: {organism}; supported: {', '.join(T.HOST_CODONS)}")
    best = T.HOST_CODONS[organism]
    letters = "".join(best)
    choices = F.array(*[F.lit(best[x]) for x in letters])
    pick = lambda aa: F.get(choices, F.instr(F.lit(letters), aa) - 1)
    prepared = (
        df.select("seq_id", F.translate(F.upper(F.replace("seq", F.lit(" "), F.lit(""))), "U", "T").alias("_s"))
        .where(F.length("_s") >= 3)
        .select("seq_id", "_s", dna.codons("_s").alias("_old"))
        .withColumn("_aa", dna.amino_array(F.col("_s")))
    )
    fresh = F.transform("_aa", lambda a: F.when(a == "*", "TAA").otherwise(F.coalesce(pick(a), F.lit("NNN"))))
    kept = prepared.select(
        "seq_id", F.length("_s").alias("original_length"), "_old", "_aa", fresh.alias("_new")
    ).withColumn("optimized_sequence", F.array_join("_new", ""))
    moved = F.size(
        F.filter(
            F.arrays_zip("_old", "_aa", "_new"),
            lambda z: (z["_old"] != z["_new"]) & (F.instr(F.lit(letters), z["_aa"]) > 0),
        )
    )
    return kept.withColumn("codon_changes", moved).select(
        "seq_id",
        "original_length",
        F.length("optimized_sequence").alias("optimized_length"),
        "optimized_sequence",
        "codon_changes",
        F.round(F.col("codon_changes") / F.size("_new") * 100, 1).alias("change_rate"),
        F.round(dna.letter_count("optimized_sequence", "GC") / F.length("optimized_sequence") * 100, 1).alias("gc_percent"),
        F.size("_aa").alias("protein_length"),
    )


def verify_backtranslation(df: DataFrame, organism: str = "ecoli") -> DataFrame:
    """Whether the optimised sequence still gives the same protein."""
    optimised = codon_optimize(df, organism).select("seq_id", "optimized_sequence")
    return df.select("seq_id", "seq").join(optimised, "seq_id").select(
        "seq_id", (dna.translate("optimized_sequence") == dna.translate("seq")).alias("same_protein")
    )


def rare_codon_clusters(df: DataFrame, rare: tuple[str, ...] = ("AGG", "AGA"), min_run: int = 2) -> DataFrame:
    """Maximal runs of consecutive rare codons."""
    hits = codon_rows(df).where(F.col("codon").isin(*rare)).select(
        "seq_id", "i", F.lit(1).alias("_one"), scan.width_block("i", 1 << 16).alias("_block")
    )
    numbered = scan.running(hits, ["seq_id"], ["i"], "_block", [("_rn", "_one", "sum", "upto")])
    return (
        numbered.groupBy("seq_id", (F.col("i") - F.col("_rn")).alias("_run"))
        .agg(F.min("i").alias("first_codon"), F.count(F.lit(1)).alias("run_length"))
        .where(F.col("run_length") >= min_run)
        .drop("_run")
    )

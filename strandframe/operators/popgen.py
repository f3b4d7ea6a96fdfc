"""Population genetics on long genotypes (locus, individual, population, gt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allele_freq(df: DataFrame) -> DataFrame:
    """Alternate allele frequency, expected and observed heterozygosity."""
    p = F.sum("gt") / (2.0 * F.count("gt"))
    stats = df.groupBy("locus", "population").agg(
        F.count("gt").alias("n"), p.alias("p"), F.avg((F.col("gt") == 1).cast("double")).alias("het_observed")
    )
    return stats.withColumn("het_expected", 2 * F.col("p") * (1 - F.col("p")))


def fst(df: DataFrame) -> DataFrame:
    """(Ht - mean Hs) / Ht per locus; Ht from the pooled frequency, 0 when Ht is 0."""
    per = df.groupBy("locus", "population").agg(F.sum("gt").alias("s"), F.count("gt").alias("n"))
    freq = F.col("s") / (2.0 * F.col("n"))
    total = per.groupBy("locus").agg(
        F.avg(2 * freq * (1 - freq)).alias("hs"), (F.sum("s") / (2.0 * F.sum("n"))).alias("pt")
    )
    ht = 2 * F.col("pt") * (1 - F.col("pt"))
    return total.select("locus", "hs", ht.alias("ht")).withColumn("fst", F.when(F.col("ht") > 0, (F.col("ht") - F.col("hs")) / F.col("ht")).otherwise(F.lit(0.0)))


def ld_d(df: DataFrame) -> DataFrame:
    """Pairwise D = sum(ab)/(4n) - pa*pb over individuals typed at both loci."""
    left = df.select("individual", F.col("locus").alias("locus_a"), F.col("gt").alias("a"))
    right = df.select("individual", F.col("locus").alias("locus_b"), F.col("gt").alias("b"))
    pairs = left.join(right, "individual").where(F.col("locus_a") < F.col("locus_b"))
    sums = pairs.groupBy("locus_a", "locus_b").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("b")).alias("sab")
    )
    d = F.col("sab") / (4.0 * F.col("n")) - (F.col("sa") / (2.0 * F.col("n"))) * (F.col("sb") / (2.0 * F.col("n")))
    return sums.select("locus_a", "locus_b", "n", F.round(d, 4).alias("d"))


def population_sizes(df: DataFrame) -> DataFrame:
    """Individuals per population: distinct first, so a large population stays split."""
    return df.select("population", "individual").distinct().groupBy("population").agg(F.count(F.lit(1)).alias("n_individuals"))

"""Variant typing, filtering, trimming and annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_type(ref: Column, alt: Column) -> Column:
    """SNV, Deletion, Insertion or MNV/Complex from the allele lengths."""
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNV").when((r > 1) & (a == 1), "Deletion").when((r == 1) & (a > 1), "Insertion").otherwise("MNV/Complex")


def variant_type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(variant_type(F.col("ref"), F.col("alt")).alias("variant_type")).agg(F.count(F.lit(1)).alias("n"))


def variant_filter(df: DataFrame, min_qual: float = 30, max_maf: float = 0.05, drop_effects: tuple[str, ...] = ("SYNONYMOUS", "INTRON")) -> DataFrame:
    """Quality and frequency filter; a missing frequency counts as 1.

    With an ``ann`` column the second ``|`` field is the effect to drop.
    """
    kept = df.where((F.col("qual") >= min_qual) & (F.coalesce("maf", F.lit(1.0)) <= max_maf))
    if "ann" in df.columns:
        effect = F.coalesce(F.get(F.split("ann", "\\|"), F.lit(1)), F.lit(""))
        kept = kept.where(~effect.isin(*drop_effects))
    return kept


def _shared_prefix(a: Column, b: Column) -> Column:
    """Common leading letters, at most one less than the shorter allele."""
    most = F.least(F.length(a), F.length(b)) - 1
    steps = F.sequence(F.lit(1), F.greatest(most, F.lit(1)))
    same = F.filter(steps, lambda i: (i <= most) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))
    return F.coalesce(F.array_max(same), F.lit(0))


def trim_alleles(df: DataFrame) -> DataFrame:
    """Drop the common suffix, then the common prefix (moving ``pos``)."""
    rev = lambda c: F.reverse(F.col(c))
    cut = df.withColumn("_k", _shared_prefix(rev("ref"), rev("alt")))
    short = cut.withColumn("_r", F.expr("substr(ref, 1, length(ref) - _k)")).withColumn("_a", F.expr("substr(alt, 1, length(alt) - _k)"))
    lead = short.withColumn("_p", _shared_prefix(F.col("_r"), F.col("_a")))
    return lead.select(
        *[c for c in df.columns if c not in ("pos", "ref", "alt")],
        (F.col("pos") + F.col("_p")).alias("pos"),
        F.expr("substr(_r, _p + 1)").alias("ref"),
        F.expr("substr(_a, _p + 1)").alias("alt"),
    )


def annotate_frequency(df: DataFrame, population: DataFrame, rare_below: float = 0.01) -> DataFrame:
    """Join population ``af`` on the exact variant; unknown frequency counts as rare."""
    keys = ["chrom", "pos", "ref", "alt"]
    return df.join(population.select(*keys, "af"), keys, "left").withColumn("rare", F.coalesce(F.col("af") < rare_below, F.lit(True)))


def annotate_significance(df: DataFrame, clinical: DataFrame) -> DataFrame:
    """Join the clinical label and its short code (P, LP, VUS, LB, B)."""
    keys = ["chrom", "pos", "ref", "alt"]
    code = (
        F.when(F.col("label") == "Pathogenic", "P")
        .when(F.col("label") == "Likely pathogenic", "LP")
        .when(F.col("label") == "Likely benign", "LB")
        .when(F.col("label") == "Benign", "B")
        .otherwise("VUS")
    )
    return df.join(clinical.select(*keys, "label"), keys, "left").withColumn("code", code)


def classify_evidence(evidence: DataFrame) -> DataFrame:
    """Class per variant from rows ``(var_id, criterion)``.

    PVS and PS are strong, PM moderate for pathogenic; BA is strong and BS
    supporting for benign; contradicting evidence gives VUS.
    """
    has = lambda *p: F.sum(F.col("criterion").rlike(f"^({'|'.join(p)})").cast("int"))
    tally = evidence.groupBy("var_id").agg(has("PVS", "PS").alias("strong"), has("PM").alias("moderate"), has("BA").alias("benign_strong"), has("BS").alias("benign_support"))
    s, m, bs, bp = (F.col(c) for c in ("strong", "moderate", "benign_strong", "benign_support"))
    verdict = (
        F.when((s + m > 0) & (bs + bp > 0), "VUS")
        .when((s >= 2) | ((s == 1) & (m >= 3)), "P")
        .when((s == 1) & (m >= 1), "LP")
        .when(bs >= 2, "B")
        .when((bs == 1) | (bp >= 2), "LB")
        .otherwise("VUS")
    )
    return tally.withColumn("acmg_class", verdict)


def plot_positions(df: DataFrame) -> DataFrame:
    """Numeric chromosome and position; names that are not numbers are left out."""
    number = F.expr("try_cast(replace(chrom, 'chr', '') AS INT)")
    return df.select("*", number.alias("chrom_number")).where(F.col("chrom_number").isNotNull())

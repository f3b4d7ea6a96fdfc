"""Differential expression on long counts (gene, sample, n) with sample metadata.

Estimators are the published closed forms (size factors: Anders and Huber 2010;
trimmed mean: Robinson and Oshlack 2010; dispersion and Wald test: a simplified
method-of-moments version of Love et al. 2014), so numbers differ from the
iterative fits of the well-known packages while ranks agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import distributions as D
from strandframe.functions.discrete import binomial_smaller_tail
from strandframe.operators.hypothesis import bh_fdr
from strandframe.plans import scan
from strandframe.plans.storage import cut_lineage, spread_rows


def _n_samples(counts: DataFrame) -> DataFrame:
    return counts.select("sample").distinct().agg(F.count(F.lit(1)).alias("_ns"))


def align_samples(counts: DataFrame, meta: DataFrame) -> DataFrame:
    """Counts of the described samples; samples on one side only are an error."""
    names = counts.select("sample").distinct()
    stray = names.join(meta, "sample", "left_anti").count() + meta.join(names, "sample", "left_anti").count()
    if stray:
        raise ValueError(f"{stray} samples differ between counts and metadata")
    return counts.join(meta, "sample")


def size_factors(counts: DataFrame) -> DataFrame:
    """Median over genes of count / geometric mean; genes with a zero are left out."""
    whole = (
        counts.where(F.col("n") > 0)
        .groupBy("gene")
        .agg(F.avg(F.log("n")).alias("_lg"), F.count(F.lit(1)).alias("_c"))
        .join(F.broadcast(_n_samples(counts)), F.col("_c") == F.col("_ns"))
        .select("gene", "_lg")
    )
    ratios = counts.join(whole, "gene").select("sample", (F.log("n") - F.col("_lg")).alias("_r"))
    return scan.exact_quantiles(ratios, ["sample"], "_r", {"_m": 0.5}).select("sample", F.exp("_m").alias("size_factor"))


def normalised_counts(counts: DataFrame) -> DataFrame:
    return counts.join(size_factors(counts), "sample").withColumn("norm", F.col("n") / F.col("size_factor"))


def counts_per_million(counts: DataFrame) -> DataFrame:
    """n / library size * 1e6; library sizes are aggregated, not windowed."""
    lib = counts.groupBy("sample").agg(F.sum("n").alias("_lib"))
    return counts.join(lib, "sample").withColumn("cpm", F.col("n") * 1e6 / F.col("_lib")).drop("_lib")


def filter_by_expression(counts: DataFrame, min_cpm: float = 1.0, min_samples: int = 3) -> DataFrame:
    """Genes that reach ``min_cpm`` in at least ``min_samples`` samples."""
    keep = counts_per_million(counts).where(F.col("cpm") >= min_cpm).groupBy("gene").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= min_samples)
    return counts.join(keep.select("gene"), "gene", "left_semi")


def tmm_factors(counts: DataFrame, reference, log_trim: float = 0.3, sum_trim: float = 0.05) -> DataFrame:
    """Trimmed mean of M values against a reference sample, scaled to product one.

    Genes are trimmed by the mid-rank of M (30 % per side) and A (5 %); weights
    are the inverse of the delta-method variance.
    """
    lib = counts.groupBy("sample").agg(F.sum("n").alias("lib"))
    base = counts.join(lib, "sample").where(F.col("n") > 0)
    ref = base.where(F.col("sample") == F.lit(reference)).select("gene", F.col("n").alias("nr"), F.col("lib").alias("lr"))
    both = base.join(ref, "gene")
    p, r = F.col("n") / F.col("lib"), F.col("nr") / F.col("lr")
    scored = both.select(
        "sample", "gene", F.log2(p / r).alias("m"), (F.log2(p * r) / 2).alias("a"),
        ((F.col("lib") - F.col("n")) / (F.col("lib") * F.col("n")) + (F.col("lr") - F.col("nr")) / (F.col("lr") * F.col("nr"))).alias("v"),
    )
    size = scored.groupBy("sample").agg(F.count(F.lit(1)).alias("_g"))
    rm = scan.midranks(scored, ["sample"], "m").select("sample", "m", F.col("midrank").alias("_rm"))
    ra = scan.midranks(scored, ["sample"], "a").select("sample", "a", F.col("midrank").alias("_ra"))
    g = F.col("_g")
    lo_m, lo_a = F.floor(g * log_trim) + 1, F.floor(g * sum_trim) + 1
    kept = scored.join(size, "sample").join(rm, ["sample", "m"]).join(ra, ["sample", "a"]).where(
        F.col("_rm").between(lo_m, g + 1 - lo_m) & F.col("_ra").between(lo_a, g + 1 - lo_a) & (F.col("v") > 0)
    )
    raw = kept.groupBy("sample").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("_log"))
    full = lib.select("sample").join(raw, "sample", "left").withColumn("_log", F.coalesce("_log", F.lit(0.0)))
    centre = full.agg(F.avg("_log").alias("_c"))
    return full.join(F.broadcast(centre), F.lit(True)).select("sample", F.pow(F.lit(2.0), F.col("_log") - F.col("_c")).alias("tmm_factor"))


def de_two_group(counts: DataFrame, meta: DataFrame, treated: str, control: str, min_base_mean: float = 10.0, column: str = "condition") -> DataFrame:
    """Two-group Wald test of normalised counts.

    dispersion: per-gene moments (v - m/s) / m^2 floored at 1e-8, trend
    a0 + a1/mean fitted by least squares over genes, shrunk half way on the log
    scale; standard error of ln fold change from sum(1/(n m) + d/n) per group.
    """
    norm = normalised_counts(counts).join(meta.select("sample", F.col(column).alias("_g")), "sample").where(F.col("_g").isin(treated, control))
    is_t = F.col("_g") == treated
    t, c = F.when(is_t, F.col("norm")), F.when(~is_t, F.col("norm"))
    # samples missing from the long table are zero counts
    sizes = meta.where(F.col(column).isin(treated, control)).agg(
        F.sum((F.col(column) == treated).cast("int")).alias("nt"), F.sum((F.col(column) == control).cast("int")).alias("nc")
    )
    sums = norm.groupBy("gene").agg(
        F.coalesce(F.sum(t), F.lit(0.0)).alias("st"), F.coalesce(F.sum(c), F.lit(0.0)).alias("sc"),
        F.coalesce(F.sum(t * t), F.lit(0.0)).alias("stt"), F.coalesce(F.sum(c * c), F.lit(0.0)).alias("scc"),
    ).join(F.broadcast(sizes), F.lit(True))
    nt, nc = F.col("nt"), F.col("nc")
    g = sums.withColumn("mt", F.col("st") / nt).withColumn("mc", F.col("sc") / nc).withColumn("baseMean", (F.col("st") + F.col("sc")) / (nt + nc))
    within = (F.col("stt") - F.col("st") * F.col("mt") + F.col("scc") - F.col("sc") * F.col("mc")) / (nt + nc - 2)
    g = g.where(F.col("baseMean") >= min_base_mean).withColumn("_disp", F.greatest(F.lit(1e-8), (within - F.col("baseMean")) / (F.col("baseMean") * F.col("baseMean"))))
    inv = 1 / F.col("baseMean")
    trend = g.agg(F.regr_slope("_disp", inv).alias("_a1"), F.regr_intercept("_disp", inv).alias("_a0"))
    fit = g.join(F.broadcast(trend), F.lit(True)).withColumn("_trend", F.greatest(F.lit(1e-8), F.coalesce("_a0", F.lit(0.0)) + F.coalesce("_a1", F.lit(0.0)) * inv))
    d = fit.withColumn("dispersion", F.exp((F.log("_disp") + F.log("_trend")) / 2))
    half = 0.5
    mt, mc = F.col("mt") + half, F.col("mc") + half
    se = F.sqrt(1 / (nt * mt) + F.col("dispersion") / nt + 1 / (nc * mc) + F.col("dispersion") / nc)
    out = d.select("gene", "baseMean", (F.log(mt / mc) / F.log(F.lit(2.0))).alias("log2FoldChange"), (se / F.log(F.lit(2.0))).alias("lfcSE"), "dispersion")
    out = spread_rows(out).withColumn("stat", F.col("log2FoldChange") / F.col("lfcSE")).withColumn("pvalue", D.normal_two_sided(F.col("stat")))
    return bh_fdr(cut_lineage(out), "pvalue", out="padj")


def shrink_fold_changes(results: DataFrame) -> DataFrame:
    """Normal-prior shrinkage: prior deviation from the 97.5 % quantile of |LFC|."""
    prior = scan.exact_quantiles(results.select(F.abs("log2FoldChange").alias("_l")), [], "_l", {"_q": 0.975}).select((F.col("_q") / 1.959963984540054).alias("_sd"))
    v, s2 = F.col("_sd") * F.col("_sd"), F.col("lfcSE") * F.col("lfcSE")
    return results.join(F.broadcast(prior), F.lit(True)).select(*results.columns, (F.col("log2FoldChange") * v / (v + s2)).alias("lfc_shrunk"))


def de_summary(results: DataFrame, alpha: float = 0.05, min_lfc: float = 1.0) -> DataFrame:
    sig = F.col("padj") < alpha
    up, down = sig & (F.col("log2FoldChange") > min_lfc), sig & (F.col("log2FoldChange") < -min_lfc)
    return results.agg(
        F.count(F.lit(1)).alias("n_tested"), F.sum(sig.cast("long")).alias("n_significant"), F.sum(up.cast("long")).alias("n_up"), F.sum(down.cast("long")).alias("n_down")
    )


def volcano(results: DataFrame, alpha: float = 0.05, min_lfc: float = 1.0) -> DataFrame:
    """-log10(padj), mean-difference coordinates and Up / Down / NS label."""
    sig = F.coalesce(F.col("padj") < alpha, F.lit(False))
    label = F.when(sig & (F.col("log2FoldChange") > min_lfc), "Up").when(sig & (F.col("log2FoldChange") < -min_lfc), "Down").otherwise("NS")
    return results.select(
        "gene", "log2FoldChange", (-F.log10(F.greatest("padj", F.lit(1e-300)))).alias("neg_log10_padj"), F.log10(F.col("baseMean") + 1).alias("log10_mean"), label.alias("direction")
    )


def row_zscore(matrix: DataFrame, value: str = "norm") -> DataFrame:
    """Per-gene z score; genes without variance give 0."""
    w = Window.partitionBy("gene")  # one row per sample and gene
    sd = F.stddev_samp(value).over(w)
    return matrix.select("gene", "sample", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(F.lit(0.0)).alias("z"))


def linear_model(matrix: DataFrame, meta: DataFrame, terms: dict[str, Column], value: str) -> DataFrame:
    """Least squares per gene on design columns built from the metadata.

    ``terms`` maps a coefficient name to its design column.  A described sample
    that a gene lacks has the value 0.  Gram sums come from one aggregation; the
    small systems are solved on gene rows.
    """
    names = ["intercept", *terms]
    design = meta.select("sample", F.lit(1.0).alias("d0"), *[c.cast("double").alias(f"d{i}") for i, c in enumerate(terms.values(), start=1)])
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    # every gene has all described samples, so the design sums are the same for all: one row
    shape = design.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(f"d{i}") * F.col(f"d{j}")) for i, j in pairs]).alias("xx"))
    sums = (
        matrix.join(design, "sample")
        .groupBy("gene")
        .agg(F.sum(F.col(value) * F.col(value)).alias("yy"), F.array(*[F.sum(F.col(f"d{i}") * F.col(value)) for i in range(p)]).alias("xy"))
        .join(F.broadcast(shape), F.lit(True))
        .where(F.col("n") > p)
    )

    def solve(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            rows = []
            for g, n, yy, xx, xy in zip(b["gene"], b["n"], b["yy"], b["xx"], b["xy"]):
                m = np.zeros((p, p))
                for (i, j), v in zip(pairs, xx):
                    m[i, j] = m[j, i] = v
                inv = np.linalg.pinv(m)
                beta = inv @ np.asarray(xy)
                rss = max(yy - float(beta @ np.asarray(xy)), 0.0)
                for k, name in enumerate(names):
                    rows.append((g, name, float(beta[k]), float(inv[k, k]), rss, float(n - p)))
            yield pd.DataFrame(rows, columns=["gene", "term", "estimate", "unscaled", "rss", "df_residual"])

    kind = dict(matrix.dtypes)["gene"]
    return sums.mapInPandas(solve, f"gene {kind}, term string, estimate double, unscaled double, rss double, df_residual double")


def _variance_prior(level: float | None, spread: float | None) -> tuple[float, float]:
    """Degrees of freedom and variance of the prior from mean and excess variance of the log variances.

    trigamma(d / 2) = spread is solved by Newton steps on its reciprocal, which
    rise to the root from below; infinite degrees where nothing is in excess.
    """
    if level is None:
        return 0.0, 1.0
    if spread is None or spread <= 0:
        return math.inf, math.exp(level)
    y = 0.5 + 1 / spread
    while True:
        now = D.trigamma_of(y)
        step = now * (1 - now / spread) / D.tetragamma_of(y)
        y += step
        if abs(step) < 1e-12 * y:
            return 2 * y, math.exp(level + D.digamma_of(y) - math.log(y))


def moderated_t(fit: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Empirical-Bayes moderated t (Smyth 2004) for the named coefficients.

    Prior variance and degrees of freedom come from the mean and variance of
    log residual variances over genes.
    """
    s2 = fit.where(F.col("rss") > 0).select("gene", (F.col("rss") / F.col("df_residual")).alias("s2"), F.col("df_residual").alias("d")).distinct()
    half = F.col("d") / 2
    level = F.log("s2") - D.digamma(half) + F.log(half)
    hyper = s2.agg(F.avg(level).alias("_e"), (F.var_samp(level) - F.avg(D.trigamma(half))).alias("_v"), F.avg("s2").alias("_m")).first()
    prior_d, prior_s = _variance_prior(hyper["_e"], hyper["_v"])
    post = fit.where(F.col("term").isin(*terms))
    if prior_d == math.inf:  # the variances spread no more than chance: all genes share one
        s2p, dof = F.lit(prior_s), F.lit(math.inf)
    else:
        s2p = (prior_d * prior_s + F.col("rss")) / (prior_d + F.col("df_residual"))
        dof = prior_d + F.col("df_residual")
    out = post.select("gene", "term", "estimate", (F.col("estimate") / F.sqrt(s2p * F.col("unscaled"))).alias("t"), dof.alias("dof"))
    tail = D.normal_two_sided(F.col("t")) if prior_d == math.inf else D.t_two_sided(F.col("t"), F.col("dof"))
    out = spread_rows(out).withColumn("p", tail)
    return bh_fdr(cut_lineage(out), "p", by=["term"], out="padj")


def nested_model_test(full: DataFrame, reduced: DataFrame) -> DataFrame:
    """Full against reduced linear model per gene: deviance n ln(rss0/rss1), chi-squared."""
    per = lambda f, r, d: f.groupBy("gene").agg(F.max("rss").alias(r), F.max("df_residual").alias(d), F.count(F.lit(1)).alias(f"k{d}"))
    j = per(full, "r1", "d1").join(per(reduced, "r0", "d0"), "gene").where((F.col("r1") > 0) & (F.col("r0") > 0))
    n = F.col("d1") + F.col("kd1")
    lr = F.greatest(F.lit(0.0), n * F.log(F.col("r0") / F.col("r1")))
    out = j.select("gene", lr.alias("deviance"), (F.col("d0") - F.col("d1")).alias("dof")).where(F.col("dof") > 0)
    return bh_fdr(cut_lineage(spread_rows(out).withColumn("p", D.chi2_upper(F.col("deviance"), F.col("dof")))), "p", out="padj")


def exact_two_sample(counts: DataFrame, a, b) -> DataFrame:
    """No-replicate comparison of two samples: conditional binomial test per gene.

    Given the gene total, the count of ``a`` is binomial with the library share;
    the two-sided p doubles the smaller tail (at most 1).
    """
    sa, sb = F.col("sample") == F.lit(a), F.col("sample") == F.lit(b)
    lib = counts.where(sa | sb).agg(F.sum(F.when(sa, F.col("n"))).alias("la"), F.sum(F.when(sb, F.col("n"))).alias("lb"))
    per = counts.where(sa | sb).groupBy("gene").agg(
        F.coalesce(F.sum(F.when(sa, F.col("n"))), F.lit(0)).alias("xa"), F.coalesce(F.sum(F.when(sb, F.col("n"))), F.lit(0)).alias("xb")
    ).where(F.col("xa") + F.col("xb") > 0)
    j = spread_rows(per).join(F.broadcast(lib), F.lit(True)).withColumn("share", F.col("la") / (F.col("la") + F.col("lb")))
    xa, n, s = F.col("xa"), F.col("xa") + F.col("xb"), F.col("share")
    out = j.select("gene", "xa", "xb", F.log2(((xa + 0.5) / F.col("la")) / ((F.col("xb") + 0.5) / F.col("lb"))).alias("log2FoldChange"), binomial_smaller_tail(xa, n, s).alias("p"))
    return bh_fdr(cut_lineage(out), "p", out="padj")

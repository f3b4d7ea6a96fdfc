"""Negative-binomial models of counts: fits with any design, contrasts, likelihood-ratio and exact tests.

A gene is one row that holds its counts of all described samples (absent ones are
zero), so one shuffle brings the data together and all genes of an Arrow batch are
then fitted at once.  The design has one row per sample and travels with the code.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import distributions as D
from strandframe.functions.discrete import log_side
from strandframe.operators.expression import size_factors
from strandframe.operators.hypothesis import bh_fdr
from strandframe.plans.storage import cut_lineage, spread_rows

#: Least fitted mean, which keeps genes with an empty group finite, and the ridge of the weighted sums.
LEAST_MEAN, RIDGE = 0.5, 1e-6
#: Counts of one block of genes that are fitted together.
BLOCK = 1 << 20
FIT = "beta array<double>, covariance array<double>, dispersion double, base_mean double, deviance double, rounds int, converged boolean"


class Design:
    """Samples in order with their log size factors and design rows (``intercept`` and one column per term)."""

    def __init__(self, meta: DataFrame, factors: DataFrame, terms: dict[str, Column]):
        # one row per sample of the experiment
        rows = meta.join(factors, "sample", "left").select(
            "sample", F.log(F.coalesce("size_factor", F.lit(1.0))).alias("_offset"), *[c.cast("double").alias(f"_d{i}") for i, c in enumerate(terms.values())]
        ).orderBy("sample").collect()
        self.names = ["intercept", *terms]
        self.samples = [r["sample"] for r in rows]
        self.offset = np.array([r["_offset"] for r in rows])
        self.x = np.array([[1.0, *[r[f"_d{i}"] for i in range(len(terms))]] for r in rows])
        if not len(self.x) or np.linalg.matrix_rank(self.x) < len(self.names):
            raise ValueError("the design must have full rank over the described samples")


def deviance(y: np.ndarray, mu: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Negative-binomial deviance per row; dispersion 0 is the Poisson one."""
    a = alpha[:, None]
    near = np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0.0)
    wide = np.where(a > 0, (y + 1 / np.maximum(a, 1e-300)) * np.log1p(a * (y - mu) / (1 + a * mu)), y - mu)
    return 2 * (near - wide).sum(axis=1)


def reweighted(y: np.ndarray, x: np.ndarray, offset: np.ndarray, alpha: np.ndarray, rounds: int, tol: float) -> tuple[np.ndarray, ...]:
    """Iteratively reweighted least squares of all rows of ``y``: beta, covariance, mean, deviance, rounds used, settled."""
    genes, p = len(y), x.shape[1]
    outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), p * p)

    def gram(weights: np.ndarray) -> np.ndarray:
        return (weights @ outer).reshape(-1, p, p) + RIDGE * np.eye(p)

    mu = y + 0.1 * np.exp(offset)
    beta, dev = np.zeros((genes, p)), np.full(genes, np.inf)
    used, settled = np.zeros(genes, np.int32), np.zeros(genes, bool)
    for _ in range(rounds):
        go = np.flatnonzero(~settled)
        if not len(go):
            break
        m = np.maximum(mu[go], LEAST_MEAN)
        w = m / (1 + alpha[go, None] * m)
        z = np.log(m) - offset + (y[go] - m) / m
        beta[go] = np.linalg.solve(gram(w), ((w * z) @ x)[..., None])[..., 0]
        mu[go] = np.exp(np.clip(beta[go] @ x.T + offset, -30, 30))
        now = deviance(y[go], np.maximum(mu[go], LEAST_MEAN), alpha[go])
        settled[go] = np.abs(now - dev[go]) < tol * (np.abs(now) + 0.1)
        dev[go] = now
        used[go] += 1
    m = np.maximum(mu, LEAST_MEAN)
    return beta, np.linalg.inv(gram(m / (1 + alpha[:, None] * m))), m, dev, used, settled


def pearson_dispersion(y: np.ndarray, mu: np.ndarray, spare: int, low: float = 1e-8, high: float = 1e3) -> np.ndarray:
    """Dispersion at which the Pearson statistic equals the degrees of freedom left, by bisection on the log scale."""
    lo, hi = np.full(len(y), np.log(low)), np.full(len(y), np.log(high))
    for _ in range(60):
        mid = (lo + hi) / 2
        over = ((y - mu) ** 2 / (mu + np.exp(mid)[:, None] * mu * mu)).sum(axis=1) > spare
        lo, hi = np.where(over, mid, lo), np.where(over, hi, mid)
    return np.exp((lo + hi) / 2)


def _gene_rows(counts: DataFrame, design: Design) -> DataFrame:
    """gene and its counts by place of the sample; samples without metadata are left out."""
    known = F.create_map(*[v for k, s in enumerate(design.samples) for v in (F.lit(s), F.lit(k))])
    placed = counts.select("gene", F.element_at(known, F.col("sample")).alias("_at"), "n").where("_at is not null and n is not null")
    return placed.groupBy("gene", "_at").agg(F.sum("n").cast("double").alias("n")).groupBy("gene").agg(F.collect_list("_at").alias("at"), F.collect_list("n").alias("n"))


def nb_fit(
    counts: DataFrame, meta: DataFrame, terms: dict[str, Column], dispersion: DataFrame | float | None = None, factors: DataFrame | None = None,
    rounds: int = 50, tol: float = 1e-8,
) -> DataFrame:
    """Negative-binomial log-linear model per gene: gene, beta, covariance, dispersion, base_mean, deviance, rounds, converged.

    ``counts`` is (gene, sample, n), a sample that a gene lacks counts 0; ``meta``
    describes the samples, ``terms`` maps names to design columns of it (an
    intercept comes first); their product is an interaction.  ``factors`` (sample,
    size_factor) default to the median ratios.  ``dispersion`` is (gene, dispersion),
    one number, or None: then the gene's own Pearson estimate under this design.
    ``beta`` is in natural logs, ``covariance`` row by row.  ``tol`` 0 makes every
    gene take exactly ``rounds`` rounds.  Genes with zero counts only get means at
    the floor.  No counts: no rows.
    """
    design = Design(meta, size_factors(counts) if factors is None else factors, terms)
    x, offset, width = design.x, design.offset, len(design.samples)
    rows = _gene_rows(counts, design)
    if isinstance(dispersion, DataFrame):
        rows = rows.join(dispersion.select("gene", F.col("dispersion").cast("double").alias("dispersion")), "gene")
    else:
        rows = rows.withColumn("dispersion", F.lit(dispersion).cast("double"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = max(1, BLOCK // width)
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.iloc[start : start + size]
                y = np.zeros((len(part), width))
                for k, (at, n) in enumerate(zip(part["at"], part["n"], strict=True)):
                    y[k, at] = n
                alpha = part["dispersion"].to_numpy(float)
                if np.isnan(alpha).any():
                    alpha = np.zeros(len(y))
                    for _ in range(3):
                        alpha = pearson_dispersion(y, reweighted(y, x, offset, alpha, rounds, tol)[2], width - x.shape[1])
                beta, cov, _, dev, used, settled = reweighted(y, x, offset, alpha, rounds, tol)
                yield pd.DataFrame({
                    "gene": part["gene"], "beta": list(beta), "covariance": list(cov.reshape(len(y), -1)), "dispersion": alpha,
                    "base_mean": (y / np.exp(offset)).mean(axis=1), "deviance": dev, "rounds": used, "converged": settled,
                })

    kind = dict(counts.dtypes)["gene"]
    return rows.mapInPandas(fit, f"gene {kind}, {FIT}")


def trended_dispersion(fit: DataFrame) -> DataFrame:
    """gene, dispersion: half way on the log scale from the gene's own value to the trend a0 + a1 / mean over all genes."""
    own = fit.where("base_mean > 0").select("gene", "dispersion", (1 / F.col("base_mean")).alias("_i"))
    trend = own.agg(F.regr_slope("dispersion", "_i").alias("_a1"), F.regr_intercept("dispersion", "_i").alias("_a0"))
    level = F.greatest(F.lit(1e-8), F.coalesce("_a0", F.lit(0.0)) + F.coalesce("_a1", F.lit(0.0)) * F.col("_i"))
    return own.join(F.broadcast(trend), F.lit(True)).select("gene", F.exp((F.log("dispersion") + F.log(level)) / 2).alias("dispersion"))


def contrast(fit: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Wald test of a weighted sum of coefficients: log2FoldChange, lfcSE, stat, pvalue, padj.

    ``weights`` follow the design (intercept first).
    """
    p = len(weights)
    spots = [(i, w) for i, w in enumerate(weights) if w]
    if not spots:
        raise ValueError("a contrast needs a weight other than zero")
    value = sum((F.col("beta")[i] * w for i, w in spots), F.lit(0.0))
    spread = sum((F.col("covariance")[i * p + j] * (w * v) for i, w in spots for j, v in spots), F.lit(0.0))
    ln2 = F.log(F.lit(2.0))
    out = fit.select("gene", F.col("base_mean").alias("baseMean"), (value / ln2).alias("log2FoldChange"), (F.sqrt(spread) / ln2).alias("lfcSE"), "dispersion")
    out = spread_rows(out).withColumn("stat", F.col("log2FoldChange") / F.col("lfcSE")).withColumn("pvalue", D.normal_two_sided(F.col("stat")))
    return bh_fdr(cut_lineage(out), "pvalue", out="padj")


def likelihood_ratio(full: DataFrame, reduced: DataFrame) -> DataFrame:
    """Full against nested reduced fit of the same dispersions: stat, dof, pvalue, padj."""
    pair = full.select("gene", "deviance", F.size("beta").alias("_p")).join(
        reduced.select("gene", F.col("deviance").alias("_d0"), F.size("beta").alias("_p0")), "gene"
    )
    out = pair.select("gene", F.greatest(F.lit(0.0), F.col("_d0") - F.col("deviance")).alias("stat"), (F.col("_p") - F.col("_p0")).alias("dof")).where("dof > 0")
    return bh_fdr(cut_lineage(spread_rows(out).withColumn("pvalue", D.chi2_upper(F.col("stat"), F.col("dof")))), "pvalue", out="padj")


class Conditional:
    """Count of the first group given the total: terms by their ratio p(k + 1) / p(k), no term is stored.

    Sums of ``n1`` and ``n2`` samples with one mean and dispersion ``alpha``;
    ``alpha`` 0 is the binomial with share n1 / (n1 + n2).
    """

    def __init__(self, total: np.ndarray, n1: float, n2: float, alpha: np.ndarray):
        self.total, self.n1, self.n2, self.alpha = total, n1, n2, alpha

    def _log_ratio(self, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        s, a = self.total[rows, None], self.alpha[rows, None]
        return np.log((self.n1 + a * k) * (s - k)) - np.log((k + 1) * (self.n2 + a * (s - k - 1)))

    def log_side(self, x: np.ndarray, up: bool) -> np.ndarray:
        """ln of the sum of p(k) / p(x) over k >= x (``up``) or k <= x.

        The ratios fall along k where both groups have at least one pseudo unit (n / alpha >= 1).
        """
        return log_side(x, np.zeros(len(x)), self.total, self._log_ratio, up, np.minimum(self.n1, self.n2) >= self.alpha)

    def two_sided(self, x: np.ndarray) -> np.ndarray:
        """Twice the smaller tail, at most 1."""
        up, down = self.log_side(x, True), self.log_side(x, False)
        top = np.maximum(up, down)
        # p(x) itself is in both sides
        whole = top + np.log(np.exp(up - top) + np.exp(down - top) - np.exp(-top))
        return np.minimum(1.0, 2 * np.exp(np.minimum(up, down) - whole))


def exact_test(
    counts: DataFrame, meta: DataFrame, treated: str, control: str, dispersion: DataFrame | float, column: str = "condition"
) -> DataFrame:
    """Exact negative-binomial test of two groups: gene, sum_treated, sum_control, log2FoldChange, pvalue, padj.

    Counts are brought to the geometric mean library size and rounded; given a
    gene's total, the sum of the treated samples is compared with its distribution
    under one common mean.  ``dispersion`` is (gene, dispersion) or one number; genes
    without one are left out.  Samples a gene lacks count 0; groups of one sample
    are allowed.  Genes without any count are left out.
    """
    groups = meta.where(F.col(column).isin(treated, control)).select("sample", (F.col(column) == treated).alias("_t"))
    sizes = {r["_t"]: r["n"] for r in groups.groupBy("_t").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        raise ValueError("both groups need a sample")
    n1, n2 = float(sizes[True]), float(sizes[False])
    used = counts.join(groups, "sample")
    lib = used.groupBy("sample").agg(F.sum("n").alias("_lib"))
    common = lib.agg(F.exp(F.avg(F.log("_lib"))).alias("_common"))
    even = F.round(F.col("n") * F.col("_common") / F.col("_lib"))
    side = lambda t: F.coalesce(F.sum(F.when(F.col("_t") == t, even)), F.lit(0.0))
    sums = used.join(lib.join(F.broadcast(common), F.lit(True)), "sample").groupBy("gene").agg(side(True).alias("s1"), side(False).alias("s2")).where("s1 + s2 > 0")
    if isinstance(dispersion, DataFrame):
        sums = sums.join(dispersion.select("gene", F.col("dispersion").cast("double").alias("alpha")), "gene").where("alpha is not null")
    else:
        sums = sums.withColumn("alpha", F.lit(float(dispersion)))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.iloc[start : start + 2048]
                s1, s2 = part["s1"].to_numpy(float), part["s2"].to_numpy(float)
                yield pd.DataFrame({"gene": part["gene"], "s1": s1, "s2": s2, "pvalue": Conditional(s1 + s2, n1, n2, part["alpha"].to_numpy(float)).two_sided(s1)})

    kind = dict(counts.dtypes)["gene"]
    tested = spread_rows(sums).mapInPandas(test, f"gene {kind}, s1 double, s2 double, pvalue double")
    fold = F.log2(((F.col("s1") + 0.5) / n1) / ((F.col("s2") + 0.5) / n2))
    out = tested.select("gene", F.col("s1").alias("sum_treated"), F.col("s2").alias("sum_control"), fold.alias("log2FoldChange"), "pvalue")
    return bh_fdr(cut_lineage(out), "pvalue", out="padj")

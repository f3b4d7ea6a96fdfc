"""Negative-binomial fits, exact tests and variance priors against their defining equations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import distributions as D
from strandframe.operators import expression, glm

SAMPLES = [(i, "trt" if i >= 4 else "ctrl", i % 2, float(i % 4)) for i in range(8)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for gene in range(60):
        mean = np.exp(rng.uniform(0, 6) + np.array([0.8 * (gene % 3) * (s[1] == "trt") + 0.4 * s[2] for s in SAMPLES]))
        y = rng.poisson(rng.gamma(5, mean / 5))
        rows += [(f"g{gene}", s[0], int(n)) for s, n in zip(SAMPLES, y) if n]
    rows += [("only", 1, 40), ("one_group", 0, 30), ("one_group", 1, 42), ("one_group", 2, 25), ("one_group", 3, 60), ("zero", 2, 0), ("g1", 99, 5000), ("g2", 3, None)]
    counts = spark.createDataFrame(rows, "gene string, sample int, n long").repartition(5)
    meta = spark.createDataFrame(SAMPLES, "sample int, condition string, batch int, dose double")
    factors = spark.createDataFrame([(s[0], 0.7 + 0.1 * s[0]) for s in SAMPLES], "sample int, size_factor double")
    table = {}
    for gene, s, n in rows:
        if s < 8:
            table.setdefault(gene, np.zeros(8))[s] += n or 0
    return counts, meta, factors, table


def terms():
    return {"batch": F.col("batch"), "trt": F.col("condition") == "trt", "both": F.col("batch") * (F.col("condition") == "trt").cast("int")}


X = np.array([[1.0, s[2], s[1] == "trt", s[2] * (s[1] == "trt")] for s in SAMPLES])
OFFSET = np.log([0.7 + 0.1 * s[0] for s in SAMPLES])


@pytest.mark.parametrize("alpha", [0.0, 0.3, None])
def test_fit_solves_the_score_equations(data, alpha):
    counts, meta, factors, table = data
    found = {r.gene: r for r in glm.nb_fit(counts, meta, terms(), alpha, factors).collect()}
    assert found.keys() == table.keys()
    for gene, y in table.items():
        r = found[gene]
        assert r.base_mean == pytest.approx((y / np.exp(OFFSET)).mean())
        mu = np.exp(X @ np.array(r.beta) + OFFSET)
        if (mu > 0.6).all():
            assert r.converged
            score = X.T @ ((y - mu) / (1 + r.dispersion * mu))
            assert np.abs(score).max() < 1e-3 * (1 + y.sum())
            gram = X.T @ (X * (mu / (1 + r.dispersion * mu))[:, None])
            assert np.allclose(np.linalg.inv(gram), np.array(r.covariance).reshape(4, 4), rtol=1e-3, atol=1e-6)
            if alpha is None and 1e-6 < r.dispersion < 100:
                assert ((y - mu) ** 2 / (mu + r.dispersion * mu * mu)).sum() == pytest.approx(4, rel=0.05)
        assert np.isfinite(r.beta).all() and np.isfinite(r.deviance)
    assert {g for g, r in found.items() if not r.base_mean} == {"zero"}


def test_contrast_and_likelihood_ratio(data):
    counts, meta, factors, table = data
    full, reduced = glm.nb_fit(counts, meta, {"dose": F.col("dose"), "trt": F.col("condition") == "trt"}, 0.2, factors), glm.nb_fit(counts, meta, {"dose": F.col("dose")}, 0.2, factors)
    fits = {r.gene: r for r in full.collect()}
    for r in glm.contrast(full, [0, 3.0, -1.0]).collect():
        b, c = np.array(fits[r.gene].beta), np.array(fits[r.gene].covariance).reshape(3, 3)
        w = np.array([0, 3.0, -1.0])
        assert r.log2FoldChange == pytest.approx(w @ b / math.log(2)) and r.lfcSE == pytest.approx(math.sqrt(w @ c @ w) / math.log(2))
        assert r.pvalue == pytest.approx(math.erfc(abs(r.stat) / math.sqrt(2)), abs=1e-9) and r.padj >= r.pvalue
    plain = {r.gene: r.deviance for r in reduced.collect()}
    for r in glm.likelihood_ratio(full, reduced).collect():
        assert r.dof == 1 and r.stat == pytest.approx(max(0.0, plain[r.gene] - fits[r.gene].deviance))
        assert r.pvalue == pytest.approx(math.erfc(math.sqrt(r.stat / 2)), abs=1e-8)
    trended = glm.trended_dispersion(glm.nb_fit(counts, meta, {"dose": F.col("dose")}, None, factors))
    assert glm.nb_fit(counts, meta, {"dose": F.col("dose")}, trended, factors).count() == len(table) - 1  # no trend at mean 0


def test_designs_without_full_rank(data, spark):
    counts, meta, factors, _ = data
    with pytest.raises(ValueError):
        glm.nb_fit(counts, meta, {"a": F.col("batch"), "b": 2 * F.col("batch")}, 0.1, factors)
    with pytest.raises(ValueError):
        glm.contrast(glm.nb_fit(counts, meta, {}, 0.1, factors), [0.0])
    assert glm.nb_fit(counts.limit(0), meta, terms(), 0.1, factors).count() == 0


def naive_tail(x, total, n1, n2, alpha):
    if alpha:
        log = [math.lgamma(k + n1 / alpha) - math.lgamma(k + 1) + math.lgamma(total - k + n2 / alpha) - math.lgamma(total - k + 1) for k in range(total + 1)]
    else:
        log = [k * math.log(n1) + (total - k) * math.log(n2) - math.lgamma(k + 1) - math.lgamma(total - k + 1) for k in range(total + 1)]
    p = np.exp(np.array(log) - max(log))
    return min(1.0, 2 * min(p[x:].sum(), p[: x + 1].sum()) / p.sum())


@pytest.mark.parametrize("alpha", [0.0, 0.01, 0.5, 3.0, 40.0])
def test_conditional_tails(alpha):
    rng = random.Random(4)
    totals = [1, 2, 3, 10, 57, 400, 5000] * 6
    xs = [rng.choice([0, t, rng.randint(0, t)]) for t in totals]
    got = glm.Conditional(np.array(totals, float), 3.0, 2.0, np.full(len(xs), alpha)).two_sided(np.array(xs, float))
    assert got == pytest.approx([naive_tail(x, t, 3, 2, alpha) for x, t in zip(xs, totals)], rel=1e-7, abs=1e-300)


def test_conditional_tails_of_large_counts():
    """The binomial case has its normal limit; nothing as long as a count is stored."""
    total = np.array([1e9, 1e9])
    z = 2.5
    got = glm.Conditional(total, 1.0, 1.0, np.zeros(2)).two_sided(np.round(5e8 + z * math.sqrt(2.5e8) * np.array([1, -1])))
    assert got == pytest.approx([math.erfc(z / math.sqrt(2))] * 2, rel=2e-3)


def test_exact_test_without_replicates(spark):
    counts = spark.createDataFrame([("a", 1, 30), ("a", 2, 10), ("b", 1, 70), ("c", 2, 90), ("d", 1, 0), ("a", 3, 9)], "gene string, sample int, n long")
    meta = spark.createDataFrame([(1, "t"), (2, "c"), (3, "other")], "sample int, condition string")
    found = {r.gene: r for r in glm.exact_test(counts, meta, "t", "c", 0.4).collect()}
    assert found.keys() == {"a", "b", "c"} and found["a"].pvalue == pytest.approx(naive_tail(30, 40, 1, 1, 0.4))
    assert found["b"].pvalue == pytest.approx(naive_tail(70, 70, 1, 1, 0.4)) and found["c"].log2FoldChange < 0
    with pytest.raises(ValueError):
        glm.exact_test(counts, meta, "t", "missing", 0.4)


def test_variance_prior_inverts_trigamma(spark):
    for spread in (1e-4, 0.03, 0.7, 4.0, 900.0):
        d, s = expression._variance_prior(0.3, spread)
        assert D.trigamma_of(d / 2) == pytest.approx(spread, rel=1e-9) and s > 0
    assert expression._variance_prior(0.3, -0.1) == (math.inf, math.exp(0.3))
    assert D.trigamma_of(1.0) == pytest.approx(math.pi**2 / 6) and D.digamma_of(1.0) == pytest.approx(-0.5772156649015329)
    r = spark.range(1).select(D.trigamma(F.lit(0.5)).alias("t"), D.digamma(F.lit(0.5)).alias("d")).first()
    assert r.t == pytest.approx(math.pi**2 / 2) and r.d == pytest.approx(-0.5772156649015329 - 2 * math.log(2))


def test_moderated_t_with_equal_variances(spark):
    """No excess spread: infinite prior degrees and the normal tail."""
    fit = spark.createDataFrame([(f"g{i}", "x", float(i), 0.5, 4.0, 4.0) for i in range(5)], "gene string, term string, estimate double, unscaled double, rss double, df_residual double")
    rows = expression.moderated_t(fit, ["x"]).collect()
    assert all(r.dof == math.inf and r.p == pytest.approx(math.erfc(abs(r.t) / math.sqrt(2)), abs=1e-9) for r in rows)


def test_linear_model_counts_absent_samples_as_zero(spark):
    matrix = spark.createDataFrame([("a", 1, 2.0), ("a", 3, 6.0), ("b", 2, 1.0)], "gene string, sample int, y double")
    meta = spark.createDataFrame([(i, float(i)) for i in range(1, 5)], "sample int, x double")
    found = {(r.gene, r.term): r for r in expression.linear_model(matrix, meta, {"x": F.col("x")}, "y").collect()}
    for gene, y in (("a", [2, 0, 6, 0]), ("b", [0, 1, 0, 0])):
        slope, base = np.polyfit([1, 2, 3, 4], y, 1)
        assert found[gene, "x"].estimate == pytest.approx(slope) and found[gene, "intercept"].estimate == pytest.approx(base) and found[gene, "x"].df_residual == 2

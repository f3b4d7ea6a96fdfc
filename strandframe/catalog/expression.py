"""Registered queries on expression counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog import tails
from strandframe.catalog.base import query
from strandframe.operators import expression as E
from strandframe.operators import glm as G

_SF = """w AS (SELECT gene, avg(ln(n)) AS lg FROM counts WHERE n > 0 GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT sample) FROM counts)),
    sf AS (SELECT sample, exp(quantile_cont(ln(n) - lg, 0.5)) AS size_factor FROM counts JOIN w USING (gene) GROUP BY sample)"""


@query("size_factors", f"WITH {_SF} SELECT sample, round(size_factor, 6) AS size_factor FROM sf", ["counts"])
def _(x):
    return E.size_factors(x.counts).withColumn("size_factor", F.round("size_factor", 6))


@query("normalised_counts", f"WITH {_SF} SELECT gene, sample, n, round(n / size_factor, 6) AS norm FROM counts JOIN sf USING (sample)", ["counts"])
def _(x):
    return E.normalised_counts(x.counts).select("gene", "sample", "n", F.round("norm", 6).alias("norm"))


@query("counts_per_million", "SELECT gene, sample, round(n * 1e6 / sum(n) OVER (PARTITION BY sample), 6) AS cpm FROM counts", ["counts"])
def _(x):
    return E.counts_per_million(x.counts).select("gene", "sample", F.round("cpm", 6).alias("cpm"))


@query(
    "filter_by_expression",
    """WITH c AS (SELECT gene, n * 1e6 / sum(n) OVER (PARTITION BY sample) AS cpm FROM counts), k AS (SELECT gene FROM c WHERE cpm >= 450 GROUP BY gene HAVING count(*) >= 4)
    SELECT gene, sample, n FROM counts WHERE gene IN (SELECT gene FROM k)""",
    ["counts"],
)
def _(x):
    return E.filter_by_expression(x.counts, 450, 4).select("gene", "sample", "n")


@query(
    "tmm_factors",
    """WITH lib AS (SELECT sample, sum(n)::DOUBLE AS lib FROM counts GROUP BY sample), b AS (SELECT c.*, lib FROM counts c JOIN lib USING (sample) WHERE n > 0),
    r AS (SELECT gene, n AS nr, lib AS lr FROM b WHERE sample = 0),
    s AS (SELECT sample, gene, log2((n / lib) / (nr / lr)) AS m, log2((n / lib) * (nr / lr)) / 2 AS a, (lib - n) / (lib * n) + (lr - nr) / (lr * nr) AS v FROM b JOIN r USING (gene)),
    k AS (SELECT *, count(*) OVER (PARTITION BY sample) AS g, rank() OVER (PARTITION BY sample ORDER BY m) + (count(*) OVER (PARTITION BY sample, m) - 1) / 2.0 AS rm,
        rank() OVER (PARTITION BY sample ORDER BY a) + (count(*) OVER (PARTITION BY sample, a) - 1) / 2.0 AS ra FROM s),
    f AS (SELECT sample, sum(m / v) / sum(1 / v) AS l FROM k WHERE rm BETWEEN floor(g * 0.3) + 1 AND g - floor(g * 0.3) AND ra BETWEEN floor(g * 0.05) + 1 AND g - floor(g * 0.05) AND v > 0 GROUP BY sample),
    a AS (SELECT sample, coalesce(l, 0) AS l FROM lib LEFT JOIN f USING (sample))
    SELECT sample, round(pow(2, l - (SELECT avg(l) FROM a)), 5) AS tmm_factor FROM a""",
    ["counts"],
)
def _(x):
    return E.tmm_factors(x.counts, 0).withColumn("tmm_factor", F.round("tmm_factor", 5))


_DE = f"""{_SF}, nm AS (SELECT gene, condition, n / size_factor AS x FROM counts JOIN sf USING (sample) JOIN meta USING (sample)),
    k AS (SELECT count(*) FILTER (condition = 'trt') AS nt, count(*) FILTER (condition = 'ctrl') AS nc FROM meta),
    s AS (SELECT gene, coalesce(sum(x) FILTER (condition = 'trt'), 0) AS st, coalesce(sum(x) FILTER (condition = 'ctrl'), 0) AS sc, coalesce(sum(x * x) FILTER (condition = 'trt'), 0) AS stt, coalesce(sum(x * x) FILTER (condition = 'ctrl'), 0) AS scc FROM nm GROUP BY gene),
    g AS (SELECT *, st / nt AS mt, sc / nc AS mc, (st + sc) / (nt + nc) AS bm FROM s, k),
    d AS (SELECT *, greatest(1e-8, ((stt - st * mt + scc - sc * mc) / (nt + nc - 2) - bm) / (bm * bm)) AS disp FROM g WHERE bm >= 10),
    t AS (SELECT regr_slope(disp, 1 / bm) AS a1, regr_intercept(disp, 1 / bm) AS a0 FROM d),
    e AS (SELECT *, exp((ln(disp) + ln(greatest(1e-8, a0 + a1 / bm))) / 2) AS dispersion FROM d, t),
    z AS (SELECT gene, bm AS "baseMean", ln((mt + 0.5) / (mc + 0.5)) / ln(2) AS lfc, sqrt(1 / (nt * (mt + 0.5)) + dispersion / nt + 1 / (nc * (mc + 0.5)) + dispersion / nc) / ln(2) AS se, dispersion FROM e),
    wt AS (SELECT *, lfc / se AS stat, {tails.normal_two_sided("lfc / se", 1200)} AS p FROM z),
    q0 AS (SELECT *, rank() OVER (ORDER BY p DESC) AS dr, count(*) OVER () AS m FROM wt),
    de AS (SELECT *, least(1.0, min(p * m / (m - dr + 1)) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS padj FROM q0)"""


def _de(x):
    return E.de_two_group(x.counts, x.meta, "trt", "ctrl")


@query(
    "de_two_group",
    f"""WITH {_DE} SELECT gene, round("baseMean", 4) AS "baseMean", round(lfc, 5) AS "log2FoldChange", round(se, 5) AS "lfcSE", round(dispersion, 5) AS dispersion, round(stat, 5) AS stat, round(p, 5) AS pvalue, round(padj, 5) AS padj FROM de""",
    ["counts", "meta"],
)
def _(x):
    return _de(x).select("gene", F.round("baseMean", 4).alias("baseMean"), *[F.round(c, 5).alias(c) for c in ("log2FoldChange", "lfcSE", "dispersion", "stat", "pvalue", "padj")])


@query("shrink_fold_changes", f"WITH {_DE}, pr AS (SELECT quantile_cont(abs(lfc), 0.975) / 1.959963984540054 AS sd FROM de) SELECT gene, round(lfc * sd * sd / (sd * sd + se * se), 5) AS lfc_shrunk FROM de, pr", ["counts", "meta"])
def _(x):
    return E.shrink_fold_changes(_de(x)).select("gene", F.round("lfc_shrunk", 5).alias("lfc_shrunk"))


@query(
    "de_summary",
    f"""WITH {_DE} SELECT count(*) AS n_tested, count(*) FILTER (padj < 0.5) AS n_significant, count(*) FILTER (padj < 0.5 AND lfc > 0.5) AS n_up, count(*) FILTER (padj < 0.5 AND lfc < -0.5) AS n_down FROM de""",
    ["counts", "meta"],
)
def _(x):
    return E.de_summary(_de(x), 0.5, 0.5)


@query(
    "volcano",
    f"""WITH {_DE} SELECT gene, round(lfc, 5) AS "log2FoldChange", round(-log10(greatest(padj, 1e-300)), 4) AS neg_log10_padj, round(log10("baseMean" + 1), 5) AS log10_mean,
    CASE WHEN padj < 0.5 AND lfc > 0.5 THEN 'Up' WHEN padj < 0.5 AND lfc < -0.5 THEN 'Down' ELSE 'NS' END AS direction FROM de""",
    ["counts", "meta"],
)
def _(x):
    v = E.volcano(_de(x), 0.5, 0.5)
    return v.select("gene", F.round("log2FoldChange", 5).alias("log2FoldChange"), F.round("neg_log10_padj", 4).alias("neg_log10_padj"), F.round("log10_mean", 5).alias("log10_mean"), "direction")


@query(
    "row_zscore",
    """WITH z AS (SELECT gene, sample, n, avg(n) OVER w AS m, stddev_samp(n) OVER w AS s FROM counts WINDOW w AS (PARTITION BY gene))
    SELECT gene, sample, CASE WHEN s > 0 THEN round((n - m) / s, 6) ELSE 0.0 END AS z FROM z""",
    ["counts"],
)
def _(x):
    return E.row_zscore(x.counts, "n").withColumn("z", F.round("z", 6))


def _fit(x, reduced=False):
    terms = {"batch": (F.col("batch") == "b1")}
    if not reduced:
        terms["condition"] = F.col("condition") == "trt"
    logged = E.counts_per_million(x.counts).withColumn("y", F.log2(F.col("cpm") + 1))
    return E.linear_model(logged, x.meta, terms, "y")


_LM = """l AS (SELECT gene, sample, log2(n * 1e6 / sum(n) OVER (PARTITION BY sample) + 1) AS y FROM counts),
    d AS (SELECT gene, coalesce(y, 0) AS y, (batch = 'b1')::INT::DOUBLE AS b, (condition = 'trt')::INT::DOUBLE AS c FROM (SELECT DISTINCT gene FROM counts) g CROSS JOIN meta LEFT JOIN l USING (gene, sample)),
    m AS (SELECT gene, count(*) AS n, avg(y) AS my, avg(b) AS mb, avg(c) AS mc, covar_pop(y, b) AS yb, covar_pop(y, c) AS yc, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(b, c) AS bc, var_pop(y) AS yy FROM d GROUP BY gene),
    f AS (SELECT *, (yb * cc - yc * bc) / (bb * cc - bc * bc) AS beta_b, (yc * bb - yb * bc) / (bb * cc - bc * bc) AS beta_c FROM m),
    rs AS (SELECT *, greatest(n * (yy - beta_b * yb - beta_c * yc), 0) AS rss, greatest(n * (yy - yb * yb / bb), 0) AS rss0 FROM f)"""


@query("linear_model", f"WITH {_LM} SELECT gene, round(beta_b, 5) AS batch, round(beta_c, 5) AS condition, round(rss, 5) AS rss FROM rs", ["counts", "meta"])
def _(x):
    return _fit(x).groupBy("gene").agg(
        *[F.round(F.max(F.when(F.col("term") == t, F.col("estimate"))), 5).alias(t) for t in ("batch", "condition")], F.round(F.max("rss"), 5).alias("rss")
    )


def _adjusted(table: str, p: str) -> str:
    """Benjamini-Hochberg over all rows of ``table``."""
    return f"""rk AS (SELECT *, rank() OVER (ORDER BY {p} DESC) AS dr, count(*) OVER () AS tests FROM {table}),
    bh AS (SELECT *, least(1.0, min({p} * tests / (tests - dr + 1)) OVER (ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING)) AS padj FROM rk)"""


_DIGAMMA = lambda x: f"(ln({x} + 12) - 1 / (2 * ({x} + 12)) - 1 / (12 * pow({x} + 12, 2)) + 1 / (120 * pow({x} + 12, 4)) - list_sum(list_transform(range(12), lambda k: 1 / ({x} + k))))"
_TRIGAMMA = lambda x: f"(1 / ({x} + 12) + 1 / (2 * pow({x} + 12, 2)) + 1 / (6 * pow({x} + 12, 3)) - 1 / (30 * pow({x} + 12, 5)) + list_sum(list_transform(range(12), lambda k: 1 / pow({x} + k, 2))))"
# bisection on the log scale for trigamma(y) = excess, where the library takes Newton steps
_PRIOR = f"""ex AS (SELECT avg(lv) AS e, var_samp(lv) - {_TRIGAMMA("1.5::DOUBLE")} AS v FROM (SELECT ln(rss / 3) - {_DIGAMMA("1.5::DOUBLE")} + ln(1.5) AS lv FROM rs WHERE rss > 0) q),
    bs AS (SELECT 0 AS r, ln(1e-6) AS lo, ln(1e9) AS hi, v FROM ex UNION ALL
        SELECT r + 1, CASE WHEN {_TRIGAMMA("exp((lo + hi) / 2)")} > v THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_TRIGAMMA("exp((lo + hi) / 2)")} > v THEN hi ELSE (lo + hi) / 2 END, v FROM bs WHERE r < 80),
    pd AS (SELECT exp((lo + hi) / 2) AS y, e FROM bs, ex WHERE r = 80), pr AS (SELECT 2 * y AS d0, exp(e + {_DIGAMMA("y")} - ln(y)) AS s0 FROM pd)"""


@query(
    "moderated_t",
    f"""WITH {_LM}, {_PRIOR}, mt AS (SELECT gene, beta_c, d0 + 3 AS dof, beta_c / sqrt((d0 * s0 + rss) / (d0 + 3) / (n * (cc - bc * bc / bb))) AS t FROM rs, pr),
    mp AS (SELECT *, {tails.t_two_sided("t", "dof", 4000)} AS p FROM mt), {_adjusted("mp", "p")}
    SELECT gene, 'condition' AS term, round(beta_c, 5) AS estimate, round(t, 4) AS t, round(dof, 4) AS dof, round(p, 5) AS p, round(padj, 5) AS padj FROM bh""",
    ["counts", "meta"],
)
def _(x):
    found = E.moderated_t(_fit(x), ["condition"])
    return found.select("gene", "term", F.round("estimate", 5).alias("estimate"), F.round("t", 4).alias("t"), F.round("dof", 4).alias("dof"), F.round("p", 5).alias("p"), F.round("padj", 5).alias("padj"))


@query(
    "nested_model_test",
    f"""WITH {_LM}, lr AS (SELECT gene, greatest(0, n * ln(rss0 / rss)) AS deviance FROM rs WHERE rss > 0 AND rss0 > 0), lp AS (SELECT *, {tails.chi2_upper("deviance", "1")} AS p FROM lr), {_adjusted("lp", "p")}
    SELECT gene, round(deviance, 4) AS deviance, 1.0::DOUBLE AS dof, round(p, 5) AS p, round(padj, 5) AS padj FROM bh""",
    ["counts", "meta"],
)
def _(x):
    found = E.nested_model_test(_fit(x), _fit(x, reduced=True))
    return found.select("gene", F.round("deviance", 4).alias("deviance"), "dof", F.round("p", 5).alias("p"), F.round("padj", 5).alias("padj"))


#: Rounds of the fits that are compared with SQL.
_ROUNDS = 8


def _nb_sql(name: str, second: str) -> str:
    """Reweighted least squares of the counts on a batch and a second column, with the 3 x 3 inverse written out."""
    mean = "greatest(CASE WHEN r = 0 THEN y + 0.1 * exp(o) ELSE exp(b0 + b1 * x1 + b2 * x2 + o) END, 0.5)"
    gram = ", ".join(f"sum(w * x{i} * x{j}) + {'1e-6' if i == j else '0'} AS a{i}{j}" for i in range(3) for j in range(i, 3))
    inverse = """a11 * a22 - a12 * a12 AS c00, a02 * a12 - a01 * a22 AS c01, a01 * a12 - a02 * a11 AS c02, a00 * a22 - a02 * a02 AS c11, a01 * a02 - a00 * a12 AS c12, a00 * a11 - a01 * a01 AS c22"""
    cells = f"SELECT t.*, y, o, x0, x1, {second} AS x2, {mean} AS m FROM {{}} t JOIN gr USING (gene)"
    return f"""{name} AS (SELECT 0 AS r, gene, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM (SELECT DISTINCT gene FROM counts) g
        UNION ALL
        SELECT r + 1, gene, (c00 * v0 + c01 * v1 + c02 * v2) / det, (c01 * v0 + c11 * v1 + c12 * v2) / det, (c02 * v0 + c12 * v1 + c22 * v2) / det
        FROM (SELECT *, a00 * c00 + a01 * c01 + a02 * c02 AS det FROM (SELECT *, {inverse} FROM (
            SELECT r, gene, {gram}, sum(w * z * x0) AS v0, sum(w * z * x1) AS v1, sum(w * z * x2) AS v2
            FROM (SELECT *, m / (1 + 0.1 * m) AS w, ln(m) - o + (y - m) / m AS z FROM ({cells.format(name)}) q) q WHERE r < {_ROUNDS} GROUP BY r, gene) q) q) q),
    {name}_end AS (SELECT gene, b0, b1, b2, base_mean, deviance, c00 / det AS k00, c01 / det AS k01, c02 / det AS k02, c11 / det AS k11, c12 / det AS k12, c22 / det AS k22
        FROM (SELECT *, a00 * c00 + a01 * c01 + a02 * c02 AS det FROM (SELECT *, {inverse} FROM (
            SELECT gene, b0, b1, b2, avg(y / exp(o)) AS base_mean, 2 * sum(CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END - (y + 10) * ln(1 + 0.1 * (y - m) / (1 + 0.1 * m))) AS deviance, {gram}
            FROM (SELECT *, m / (1 + 0.1 * m) AS w FROM ({cells.format(name)}) q) q WHERE r = {_ROUNDS} GROUP BY gene, b0, b1, b2) q) q) q)"""


_GRID = f"""{_SF}, gr AS (SELECT gene, coalesce(n, 0)::DOUBLE AS y, ln(size_factor) AS o, 1.0::DOUBLE AS x0, (batch = 'b1')::INT::DOUBLE AS x1, (condition = 'trt')::INT::DOUBLE AS c
    FROM (SELECT DISTINCT gene FROM counts) g CROSS JOIN meta JOIN sf USING (sample) LEFT JOIN counts USING (gene, sample))"""


def _nb(x, reduced=False):
    terms = {"batch": F.col("batch") == "b1"} | ({} if reduced else {"condition": F.col("condition") == "trt"})
    return G.nb_fit(x.counts, x.meta, terms, dispersion=0.1, rounds=_ROUNDS, tol=0.0)


@query(
    "nb_glm",
    f"""WITH {_GRID}, {_nb_sql("nb", "c")} SELECT gene, round(b0, 4) AS intercept, round(b1, 4) AS batch, round(b2, 4) AS condition, round(sqrt(k22), 4) AS condition_se, round(base_mean, 4) AS base_mean,
    round(deviance, 3) AS deviance, {_ROUNDS} AS rounds FROM nb_end""",
    ["counts", "meta"],
)
def _(x):
    return _nb(x).select(
        "gene", *[F.round(F.col("beta")[i], 4).alias(t) for i, t in enumerate(("intercept", "batch", "condition"))], F.round(F.sqrt(F.col("covariance")[8]), 4).alias("condition_se"),
        F.round("base_mean", 4).alias("base_mean"), F.round("deviance", 3).alias("deviance"), "rounds",
    )


@query(
    "nb_contrast",
    f"""WITH {_GRID}, {_nb_sql("nb", "c")}, st AS (SELECT gene, base_mean, (b2 - b1) / ln(2) AS lfc, sqrt(k11 + k22 - 2 * k12) / ln(2) AS se FROM nb_end),
    pv AS (SELECT *, {tails.normal_two_sided("lfc / se", 1200)} AS p FROM st), {_adjusted("pv", "p")}
    SELECT gene, round(base_mean, 4) AS "baseMean", round(lfc, 4) AS "log2FoldChange", round(se, 4) AS "lfcSE", round(lfc / se, 3) AS stat, round(p, 4) AS pvalue, round(padj, 4) AS padj FROM bh""",
    ["counts", "meta"],
)
def _(x):
    found = G.contrast(_nb(x), [0.0, -1.0, 1.0])
    return found.select("gene", *[F.round(c, d).alias(c) for c, d in (("baseMean", 4), ("log2FoldChange", 4), ("lfcSE", 4), ("stat", 3), ("pvalue", 4), ("padj", 4))])


@query(
    "nb_likelihood_ratio",
    f"""WITH {_GRID}, {_nb_sql("nb", "c")}, {_nb_sql("nr", "0.0::DOUBLE")}, st AS (SELECT gene, greatest(0, q.deviance - nb_end.deviance) AS s FROM nb_end JOIN nr_end q USING (gene)),
    pv AS (SELECT *, {tails.chi2_upper("s", "1")} AS p FROM st), {_adjusted("pv", "p")} SELECT gene, round(s, 3) AS stat, 1 AS dof, round(p, 4) AS pvalue, round(padj, 4) AS padj FROM bh""",
    ["counts", "meta"],
)
def _(x):
    found = G.likelihood_ratio(_nb(x), _nb(x, reduced=True))
    return found.select("gene", F.round("stat", 3).alias("stat"), "dof", F.round("pvalue", 4).alias("pvalue"), F.round("padj", 4).alias("padj"))


@query(
    "exact_nb_test",
    f"""WITH lb AS (SELECT sample, sum(n)::DOUBLE AS lib, condition = 'trt' AS t FROM counts JOIN meta USING (sample) GROUP BY ALL), cm AS (SELECT exp(avg(ln(lib))) AS c FROM lb),
    sm AS (SELECT gene, coalesce(sum(round(n * c / lib)) FILTER (t), 0)::BIGINT AS s1, coalesce(sum(round(n * c / lib)) FILTER (NOT t), 0)::BIGINT AS s2 FROM counts JOIN lb USING (sample), cm GROUP BY gene),
    k AS (SELECT gene, s1, s2, unnest(range(0, s1 + s2 + 1)) AS k FROM sm WHERE s1 + s2 > 0),
    lg AS (SELECT *, lgamma(k + 30) - lgamma(k + 1) + lgamma(s1 + s2 - k + 30) - lgamma(s1 + s2 - k + 1) AS l FROM k),
    pk AS (SELECT *, exp(l - max(l) OVER (PARTITION BY gene)) AS p FROM lg),
    pv AS (SELECT gene, any_value(s1) AS s1, any_value(s2) AS s2, least(1.0, 2 * least(sum(p) FILTER (k >= s1), sum(p) FILTER (k <= s1)) / sum(p)) AS p FROM pk GROUP BY gene), {_adjusted("pv", "p")}
    SELECT gene, s1::DOUBLE AS sum_treated, s2::DOUBLE AS sum_control, round(log2((s1 + 0.5) / (s2 + 0.5)), 5) AS "log2FoldChange", round(p, 6) AS pvalue, round(padj, 6) AS padj FROM bh""",
    ["counts", "meta"],
)
def _(x):
    found = G.exact_test(x.counts, x.meta, "trt", "ctrl", 0.1)
    return found.select("gene", "sum_treated", "sum_control", *[F.round(c, d).alias(c) for c, d in (("log2FoldChange", 5), ("pvalue", 6), ("padj", 6))])


@query(
    "exact_two_sample",
    """WITH l AS (SELECT sum(n) FILTER (sample = 0) AS la, sum(n) FILTER (sample = 3) AS lb FROM counts),
    g AS (SELECT gene, coalesce(sum(n) FILTER (sample = 0), 0)::BIGINT AS xa, coalesce(sum(n) FILTER (sample = 3), 0)::BIGINT AS xb FROM counts WHERE sample IN (0, 3) GROUP BY gene),
    k AS (SELECT gene, xa, xb, la, lb, la / (la + lb) AS s, unnest(range(0, xa + xb + 1)) AS k FROM g, l WHERE xa + xb > 0),
    p AS (SELECT *, exp(lgamma(xa + xb + 1) - lgamma(k + 1) - lgamma(xa + xb - k + 1) + k * ln(s) + (xa + xb - k) * ln(1 - s)) AS p FROM k)
    SELECT gene, any_value(xa) AS xa, any_value(xb) AS xb, round(any_value(log2(((xa + 0.5) / la) / ((xb + 0.5) / lb))), 5) AS "log2FoldChange",
    round(least(1.0, 2 * least(sum(p) FILTER (k >= xa), sum(p) FILTER (k <= xa))), 5) AS p FROM p GROUP BY gene""",
    ["counts"],
)
def _(x):
    r = E.exact_two_sample(x.counts, 0, 3)
    return r.select("gene", "xa", "xb", F.round("log2FoldChange", 5).alias("log2FoldChange"), F.round("p", 5).alias("p"))

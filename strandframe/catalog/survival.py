"""Registered queries on survival data."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog import tails
from strandframe.catalog.base import query
from strandframe.operators import survival as S

_KM = """p AS (SELECT grp, time, sum(event) AS d, count(*) AS l FROM survival GROUP BY ALL),
    r AS (SELECT *, sum(l) OVER (PARTITION BY grp ORDER BY time DESC) AS n FROM p),
    km AS (SELECT grp, time, d, l, n, CASE WHEN max((d = n)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d = n THEN 0 ELSE ln(1 - d / n) END) OVER w) END AS s FROM r WINDOW w AS (PARTITION BY grp ORDER BY time))"""


@query("kaplan_meier", f"WITH {_KM} SELECT grp, time, d::BIGINT AS deaths, (l - d)::BIGINT AS censored, n::BIGINT AS at_risk, round(s, 6) AS survival FROM km", ["survival"])
def _(x):
    return S.kaplan_meier(S.valid_rows(x.survival), "grp").withColumn("survival", F.round("survival", 6))


@query("median_survival", f"WITH {_KM} SELECT grp, min(time) FILTER (s <= 0.5) AS median_time FROM km GROUP BY grp", ["survival"])
def _(x):
    return S.median_survival(S.kaplan_meier(x.survival, "grp"), "grp")


@query("censoring_rate", "SELECT grp, count(*) AS n, sum(event)::BIGINT AS events, round(1 - avg(event), 6) AS censored FROM survival GROUP BY grp", ["survival"])
def _(x):
    return S.censoring_rate(x.survival, ["grp"]).withColumn("censored", F.round("censored", 6))


_SPLIT = "sp AS (SELECT *, CASE WHEN x1 >= (SELECT quantile_cont(x1, 0.5) FROM survival) THEN 'High' ELSE 'Low' END AS g FROM survival)"


@query("median_split", f"WITH {_SPLIT} SELECT subject, g AS \"group\" FROM sp", ["survival"])
def _(x):
    return S.median_split(x.survival, "x1").select("subject", "group")


@query(
    "logrank",
    f"""WITH {_SPLIT}, p AS (SELECT time, sum(event) AS d, sum(event) FILTER (g = 'High') AS d1, count(*) AS l, count(*) FILTER (g = 'High') AS l1 FROM sp GROUP BY time),
    r AS (SELECT time, d, coalesce(d1, 0) AS d1, sum(l) OVER w AS n, sum(l1) OVER w AS n1 FROM p WINDOW w AS (ORDER BY time DESC)),
    s AS (SELECT sum(d1) AS o, sum(d * n1 / n) AS e, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r WHERE d > 0)
    SELECT o::BIGINT AS observed, round(e, 5) AS expected, round(v, 5) AS variance, round((o - e) * (o - e) / v, 5) AS chi2, round({tails.chi2_upper("(o - e) * (o - e) / v", "1")}, 5) AS p FROM s""",
    ["survival"],
)
def _(x):
    r = S.logrank(S.median_split(x.survival, "x1"), "group", "High", "Low")
    return r.select("observed", *[F.round(c, 5).alias(c) for c in ("expected", "variance", "chi2", "p")])


def _fit(x):
    return S.cox_ph(x.survival, ["x1", "x2"])


# Newton steps of the penalised Breslow likelihood on centred covariates, with the 2 x 2 inverse written out
_COX = """ms AS (SELECT avg(x1) AS m1, avg(x2) AS m2, count(*) AS n FROM survival), ce AS (SELECT time, event, x1 - m1 AS u, x2 - m2 AS v, n FROM survival, ms),
    cx AS (SELECT 0 AS r, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 1.0::DOUBLE AS h11, 0.0::DOUBLE AS h12, 1.0::DOUBLE AS h22 UNION ALL
        SELECT r + 1, b1 + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b2 + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12), h11, h12, h22 FROM (
            SELECT r, b1, b2, sum(du - d * s1 / s) - any_value(n) * 0.01 * b1 AS g1, sum(dv - d * s2 / s) - any_value(n) * 0.01 * b2 AS g2,
                sum(d * (s11 / s - s1 * s1 / (s * s))) + any_value(n) * 0.01 AS h11, sum(d * (s12 / s - s1 * s2 / (s * s))) AS h12, sum(d * (s22 / s - s2 * s2 / (s * s))) + any_value(n) * 0.01 AS h22
            FROM (SELECT *, sum(w) OVER o AS s, sum(w1) OVER o AS s1, sum(w2) OVER o AS s2, sum(w11) OVER o AS s11, sum(w12) OVER o AS s12, sum(w22) OVER o AS s22
                FROM (SELECT r, b1, b2, n, time, sum(e) AS w, sum(e * u) AS w1, sum(e * v) AS w2, sum(e * u * u) AS w11, sum(e * u * v) AS w12, sum(e * v * v) AS w22, sum(event) AS d, sum(event * u) AS du, sum(event * v) AS dv
                    FROM (SELECT cx.r, cx.b1, cx.b2, ce.*, exp(cx.b1 * u + cx.b2 * v) AS e FROM cx, ce WHERE cx.r < 9) q GROUP BY ALL) q
                WINDOW o AS (ORDER BY time DESC)) q GROUP BY r, b1, b2) q),
    bt AS (SELECT * FROM cx WHERE r = 9)"""


@query(
    "cox_ph",
    f"""WITH {_COX}, cf AS (SELECT 'x1' AS covariate, b1 AS coef, sqrt(h22 / (h11 * h22 - h12 * h12)) AS se FROM bt UNION ALL SELECT 'x2', b2, sqrt(h11 / (h11 * h22 - h12 * h12)) FROM bt)
    SELECT covariate, round(coef, 6) AS coef, round(se, 6) AS se, round(exp(coef), 6) AS hazard_ratio, round(exp(coef - 1.959963984540054 * se), 6) AS ci_low, round(exp(coef + 1.959963984540054 * se), 6) AS ci_high,
    round(coef / se, 4) AS z, round({tails.normal_two_sided("coef / se", 1200)}, 5) AS p FROM cf""",
    ["survival"],
)
def _(x):
    digits = {"z": 4, "p": 5}
    fit = _fit(x)
    return fit.select("covariate", *[F.round(c, digits.get(c, 6)).alias(c) for c in fit.columns if c != "covariate"])


@query(
    "schoenfeld_test",
    f"""WITH {_COX}, w AS (SELECT time, event, x1, x2, exp(b1 * x1 + b2 * x2) AS w FROM survival, bt),
    p AS (SELECT time, sum(w) AS w, sum(w * x1) AS w1, sum(w * x2) AS w2 FROM w GROUP BY time),
    m AS (SELECT time, sum(w1) OVER o / sum(w) OVER o AS m1, sum(w2) OVER o / sum(w) OVER o AS m2 FROM p WINDOW o AS (ORDER BY time DESC)),
    r AS (SELECT 'x1' AS covariate, time, x1 - m1 AS r FROM w JOIN m USING (time) WHERE event = 1 UNION ALL SELECT 'x2', time, x2 - m2 FROM w JOIN m USING (time) WHERE event = 1),
    c AS (SELECT covariate, count(*) AS n, corr(time, r) AS r FROM r GROUP BY covariate)
    SELECT covariate, n, round(r, 6) AS r, round({tails.t_two_sided("r * sqrt((n - 2) / (1 - r * r))", "(n - 2)")}, 5) AS p FROM c""",
    ["survival"],
)
def _(x):
    found = S.schoenfeld_test(x.survival, S.coefficients(_fit(x)))
    return found.select("covariate", "n", F.round("r", 6).alias("r"), F.round("p", 5).alias("p"))


_FIXED = {"x1": 0.25, "x2": -0.5}


@query(
    "schoenfeld_residuals",
    f"""WITH w AS (SELECT time, event, x1, x2, exp(0.25 * x1 - 0.5 * x2) AS w FROM survival),
    p AS (SELECT time, sum(w) AS w, sum(w * x1) AS w1, sum(w * x2) AS w2 FROM w GROUP BY time),
    m AS (SELECT time, sum(w1) OVER o / sum(w) OVER o AS m1, sum(w2) OVER o / sum(w) OVER o AS m2 FROM p WINDOW o AS (ORDER BY time DESC)),
    r AS (SELECT 'x1' AS covariate, time, x1 - m1 AS r FROM w JOIN m USING (time) WHERE event = 1 UNION ALL SELECT 'x2', time, x2 - m2 FROM w JOIN m USING (time) WHERE event = 1),
    c AS (SELECT covariate, count(*) AS n, corr(time, r) AS r FROM r GROUP BY covariate)
    SELECT covariate, n, round(r, 6) AS r, round({tails.t_two_sided("r * sqrt((n - 2) / (1 - r * r))", "(n - 2)")}, 6) AS p FROM c""",
    ["survival"],
)
def _(x):
    return S.schoenfeld_test(x.survival, _FIXED).select("covariate", "n", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"))


@query(
    "concordance_index",
    """WITH s AS (SELECT time * 2 + 1 - event AS t, event, round(0.25 * x1 - 0.5 * x2, 9) AS k FROM survival),
    c AS (SELECT count(*) FILTER (b.k < a.k)::BIGINT AS concordant, count(*) FILTER (b.k = a.k)::BIGINT AS tied, count(*)::BIGINT AS comparable FROM s a JOIN s b ON a.event = 1 AND b.t > a.t)
    SELECT *, round((concordant + 0.5 * tied) / comparable, 6) AS c_index FROM c""",
    ["survival"],
)
def _(x):
    scored = S.linear_risk(x.survival, _FIXED).withColumn("risk", F.round("risk", 9))
    return S.concordance_index(scored, "risk").withColumn("c_index", F.round("c_index", 6))


@query("parametric_survival")
def _(x):
    return S.parametric_survival(x.survival, ["x1", "x2"])

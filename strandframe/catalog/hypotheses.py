"""Registered queries on hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog import tails
from strandframe.catalog.base import query
from strandframe.operators import hypothesis as H


def _r(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if not cols or c in cols])


@query(
    "group_descriptives",
    """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
    round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS sem, round(avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS ci_low,
    round(avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS ci_high FROM orders GROUP BY o_orderpriority""",
)
def _(x):
    return _r(H.group_stats(x.table("orders"), "o_orderpriority", "o_totalprice"), digits=4)


_TWO = """t AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus = 'O') AS n2, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m1,
    avg(o_totalprice) FILTER (o_orderstatus = 'O') AS m2, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS v1, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS v2 FROM orders),
    u AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS pooled FROM t)"""
_EFFECT = "round((m1 - m2) / sqrt((v1 + v2) / 2), 6) AS cohens_d, round((m1 - m2) / sqrt(pooled), 6) AS cohens_d_pooled"


@query(
    "ttest_pooled",
    f"""WITH {_TWO}, s AS (SELECT *, (m1 - m2) / sqrt(pooled * (1.0 / n1 + 1.0 / n2)) AS t, (n1 + n2 - 2)::DOUBLE AS dof FROM u)
    SELECT n1, n2, round(t, 6) AS t, dof, {_EFFECT}, round({tails.t_two_sided("t", "dof")}, 6) AS p FROM s""",
)
def _(x):
    return _r(H.ttest(x.table("orders"), "o_orderstatus", "o_totalprice", "F", "O"))


@query(
    "ttest_welch",
    f"""WITH {_TWO}, s AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
    pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof FROM u)
    SELECT n1, n2, round(t, 6) AS t, round(dof, 6) AS dof, {_EFFECT}, round({tails.t_two_sided("t", "dof")}, 6) AS p FROM s""",
)
def _(x):
    return _r(H.ttest(x.table("orders"), "o_orderstatus", "o_totalprice", "F", "O", equal_var=False))


@query(
    "ttest_paired",
    f"""WITH d AS (SELECT l_returnflag, l_discount - l_tax AS d FROM lineitem), s AS (SELECT l_returnflag, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM d GROUP BY 1),
    t AS (SELECT l_returnflag, n, m, m / (sd / sqrt(n)) AS t, (n - 1)::DOUBLE AS dof FROM s)
    SELECT l_returnflag, n, round(m, 6) AS mean_diff, round(t, 6) AS t, dof, round({tails.t_two_sided("t", "dof")}, 6) AS p FROM t""",
)
def _(x):
    return _r(H.ttest_paired(x.table("lineitem"), "l_discount", "l_tax", by=["l_returnflag"]))


_RANKED = """r AS (SELECT {g}, {v} AS v, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {v})::DOUBLE AS t FROM {f})"""


@query(
    "mann_whitney",
    f"""WITH {_RANKED.format(g="event_type", v="value", f="events WHERE event_type IN ('view', 'click')")},
    s AS (SELECT count(*) FILTER (event_type = 'view') AS n1, count(*) FILTER (event_type = 'click') AS n2, sum(rk) FILTER (event_type = 'view') AS r1, sum(t * t - 1) AS ties FROM r),
    u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u, sqrt(n1::DOUBLE * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS sd FROM s),
    z AS (SELECT *, (greatest(u, n1::DOUBLE * n2 - u) - n1::DOUBLE * n2 / 2 - 0.5) / sd AS z FROM u)
    SELECT n1, n2, u::DOUBLE AS u, round(z, 6) AS z, round(least(1.0, {tails.normal_two_sided("z")}), 6) AS p FROM z""",
)
def _(x):
    return _r(H.mann_whitney(x.table("events"), "event_type", "value", "view", "click"))


_ANOVA = """g AS (SELECT {g}, count(*) AS n, avg({v}) AS m, var_pop({v}) AS v FROM {f} GROUP BY 1),
    a AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * v) AS ssw, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS ssb FROM g),
    f AS (SELECT k, n, (k - 1)::DOUBLE AS df_between, (n - k)::DOUBLE AS df_within, (ssb / (k - 1)) / (ssw / (n - k)) AS f, ssb / (ssb + ssw) AS eta_squared FROM a)"""


@query(
    "anova_oneway",
    f"WITH {_ANOVA.format(g='o_orderpriority', v='o_totalprice', f='orders')} SELECT k, n, df_between, df_within, round(f, 5) AS f, round(eta_squared, 6) AS eta_squared, round({tails.f_upper('f', 'df_between', 'df_within')}, 5) AS p FROM f",
)
def _(x):
    return _r(H.anova_oneway(x.table("orders"), "o_orderpriority", "o_totalprice").withColumn("f", F.round("f", 5)).withColumn("p", F.round("p", 5)))


@query(
    "levene",
    f"""WITH md AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.5) AS md FROM orders GROUP BY 1),
    z AS (SELECT g AS grp, abs(o_totalprice - md) AS z FROM orders JOIN md ON g = o_orderpriority), {_ANOVA.format(g='grp', v='z', f='z')}
    SELECT k, n, df_between, df_within, round(f, 5) AS f, round({tails.f_upper('f', 'df_between', 'df_within')}, 5) AS p FROM f""",
)
def _(x):
    return _r(H.levene(x.table("orders"), "o_orderpriority", "o_totalprice").withColumn("f", F.round("f", 5)).withColumn("p", F.round("p", 5)))


@query(
    "kruskal",
    f"""WITH {_RANKED.format(g="event_type", v="value", f="events")}, g AS (SELECT event_type, count(*) AS n, sum(rk) AS r FROM r GROUP BY 1),
    s AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(r * r / n) AS rr FROM g), t AS (SELECT sum(t * t - 1) AS ties FROM r),
    h AS (SELECT k, n, (12 / (n::DOUBLE * (n + 1)) * rr - 3 * (n + 1)) / (1 - ties / (n::DOUBLE * n * n - n)) AS h, (k - 1)::DOUBLE AS dof FROM s, t)
    SELECT k, n, round(h, 5) AS h, dof, round({tails.chi2_upper("h", "dof")}, 5) AS p FROM h""",
)
def _(x):
    return _r(H.kruskal(x.table("events"), "event_type", "value").withColumn("h", F.round("h", 5)).withColumn("p", F.round("p", 5)))


_CELLS = """c AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {f} GROUP BY ALL), ra AS (SELECT a, sum(o)::BIGINT AS r FROM c GROUP BY a), cb AS (SELECT b, sum(o)::BIGINT AS k FROM c GROUP BY b),
    n AS (SELECT sum(o)::BIGINT AS n FROM c), x AS (SELECT a, b, coalesce(o, 0) AS o, r, k, n, r::DOUBLE * k / n AS e FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN c USING (a, b))"""


@query(
    "chi2_contingency",
    f"""WITH {_CELLS.format(a='o_orderstatus', b='o_orderpriority', f='orders')},
    s AS (SELECT any_value(n) AS n, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::DOUBLE AS dof, sum((o - e) * (o - e) / e) AS chi2 FROM x)
    SELECT n, dof, round(chi2, 6) AS chi2, round({tails.chi2_upper("chi2", "dof")}, 6) AS p FROM s""",
)
def _(x):
    return _r(H.chi2_contingency(x.table("orders"), "o_orderstatus", "o_orderpriority"))


@query(
    "chi2_two_by_two",
    f"""WITH {_CELLS.format(a='quality', b='toxic', f='labels')},
    s AS (SELECT any_value(n) AS n, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::DOUBLE AS dof, sum(pow(greatest(abs(o - e) - 0.5, 0), 2) / e) AS chi2 FROM x)
    SELECT n, dof, round(chi2, 6) AS chi2, round({tails.chi2_upper("chi2", "dof")}, 6) AS p FROM s""",
)
def _(x):
    return _r(H.chi2_contingency(x.table("labels"), "quality", "toxic"))


@query("contingency_expected", f"WITH {_CELLS.format(a='o_orderstatus', b='o_orderpriority', f='orders')} SELECT a AS o_orderstatus, b AS o_orderpriority, o AS observed, round(e, 6) AS expected FROM x WHERE o > 0")
def _(x):
    return H.contingency(x.table("orders"), "o_orderstatus", "o_orderpriority").select("o_orderstatus", "o_orderpriority", "observed", F.round("expected", 6).alias("expected"))


@query(
    "fisher_exact",
    """WITH t AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F' AND l_linenumber <= 3) AS a, count(*) FILTER (l_linestatus = 'F' AND l_linenumber > 3) AS b,
        count(*) FILTER (l_linestatus <> 'F' AND l_linenumber <= 3) AS c, count(*) FILTER (l_linestatus <> 'F' AND l_linenumber > 3) AS d FROM lineitem GROUP BY 1),
    k AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS k FROM t),
    lp AS (SELECT *, lgamma(a + c + 1) - lgamma(k + 1) - lgamma(a + c - k + 1) + lgamma(b + d + 1) - lgamma(a + b - k + 1) - lgamma(b + d - (a + b - k) + 1)
        - (lgamma(a + b + c + d + 1) - lgamma(a + b + 1) - lgamma(c + d + 1)) AS lp FROM k),
    o AS (SELECT l_returnflag, lp AS obs FROM lp WHERE k = a)
    SELECT l_returnflag, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, round(any_value(a::DOUBLE * d / (b * c)), 6) AS odds_ratio,
    round(least(1.0, sum(CASE WHEN lp <= obs + 1e-7 THEN exp(lp) ELSE 0 END)), 6) AS p FROM lp JOIN o USING (l_returnflag) GROUP BY l_returnflag""",
)
def _(x):
    f, few = F.col("l_linestatus") == "F", F.col("l_linenumber") <= 3
    t = x.table("lineitem").groupBy("l_returnflag").agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("a", f & few), ("b", f & ~few), ("c", ~f & few), ("d", ~f & ~few))])
    return _r(H.fisher_exact(t))


@query(
    "pearson",
    f"""WITH s AS (SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1)
    SELECT l_returnflag, n, round(r, 6) AS r, round({tails.t_two_sided("r * sqrt((n - 2) / (1 - r * r))", "(n - 2)")}, 6) AS p FROM s""",
)
def _(x):
    return _r(H.pearson(x.table("lineitem"), "l_quantity", "l_extendedprice", by=["l_returnflag"]))


@query(
    "spearman",
    f"""WITH r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS a, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS b FROM customer),
    s AS (SELECT count(*) AS n, corr(a, b) AS r FROM r) SELECT n, round(r, 6) AS r, round({tails.t_two_sided("r * sqrt((n - 2) / (1 - r * r))", "(n - 2)")}, 6) AS p FROM s""",
)
def _(x):
    return _r(H.spearman(x.table("customer"), "c_acctbal", "c_nationkey"))


@query("shapiro")
def _(x):
    return _r(H.shapiro(x.table("orders"), "o_orderpriority", "o_totalprice", "o_orderkey"))


_GROUPS = """(SELECT {g} AS grp, count({v}) AS n, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, round(quantile_cont({v}, 0.5), 4) AS median, count(*) OVER () AS n_groups,
    sum(count(*)) OVER ()::BIGINT AS n_total FROM {f} GROUP BY {g})"""


def _shown(out):
    """One row per group beside the test."""
    rows = out.withColumn("g", F.explode("group_stats"))
    return rows.select(
        F.col("g.group").alias("grp"), F.col("g.n").alias("n"), *[F.round(F.col(f"g.{c}"), 4).alias(c) for c in ("mean", "std", "median")],
        "test", F.round("statistic", 4).alias("statistic"), F.round("p", 4).alias("p"), F.round("p_value", 4).alias("p_value"), "significant", F.round("effect_size", 4).alias("effect_size"),
        "n_groups", "n_total",
    )


@query(
    "stats_test",
    f"""WITH {_ANOVA.format(g='c_mktsegment', v='c_acctbal', f='customer')}, p AS (SELECT f, {tails.f_upper('f', 'df_between', 'df_within')} AS p FROM f)
    SELECT 'One-way ANOVA' AS test, round(f, 4) AS statistic, round(p, 4) AS p, round(p, 4) AS p_value, p < 0.05 AS significant, NULL::DOUBLE AS effect_size, g.* FROM p, {_GROUPS.format(g='c_mktsegment', v='c_acctbal', f='customer')} g""",
)
def _(x):
    return _shown(H.stats_test(x.table("customer"), "c_mktsegment", "c_acctbal"))


@query(
    "stats_test_two_groups",
    f"""WITH t AS (SELECT count(*) FILTER (l_linestatus = 'F') AS n1, count(*) FILTER (l_linestatus = 'O') AS n2, avg(l_tax) FILTER (l_linestatus = 'F') AS m1, avg(l_tax) FILTER (l_linestatus = 'O') AS m2,
        var_samp(l_tax) FILTER (l_linestatus = 'F') AS v1, var_samp(l_tax) FILTER (l_linestatus = 'O') AS v2 FROM lineitem),
    s AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t, (n1 + n2 - 2)::DOUBLE AS dof FROM t), p AS (SELECT *, {tails.t_two_sided("t", "dof")} AS p FROM s)
    SELECT 'Independent t-test' AS test, round(t, 4) AS statistic, round(p, 4) AS p, round(p, 4) AS p_value, p < 0.05 AS significant, round((m1 - m2) / sqrt((v1 + v2) / 2), 4) AS effect_size, g.*
    FROM p, {_GROUPS.format(g='l_linestatus', v='l_tax', f='lineitem')} g""",
)
def _(x):
    return _shown(H.stats_test(x.table("lineitem"), "l_linestatus", "l_tax", test="ttest"))


_PV = "SELECT p_partkey AS id, p_brand AS lib, ((p_partkey * 7919 + p_size * 31) % 1000 + 1) / 1001.0{d} AS p FROM part"


@query(
    "bh_fdr",
    f"""WITH t AS ({_PV.format(d="::DOUBLE")}), r AS (SELECT *, rank() OVER (ORDER BY p DESC) AS dr, count(*) OVER () AS m FROM t),
    k AS (SELECT *, p * m / (m - dr + 1) AS raw FROM r)
    SELECT id, round(p, 6) AS p, round(least(1.0, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q, round(least(1.0, p * m), 6) AS p_adjusted FROM k""",
)
def _(x):
    t = x.table("part").selectExpr("p_partkey AS id", "((p_partkey * 7919 + p_size * 31) % 1000 + 1) / 1001.0D AS p")
    return _r(H.bonferroni(H.bh_fdr(t)))


@query(
    "bh_fdr_by_library",
    f"""WITH t AS ({_PV.format(d="::DOUBLE")}), r AS (SELECT *, rank() OVER (PARTITION BY lib ORDER BY p DESC) AS dr, count(*) OVER (PARTITION BY lib) AS m FROM t),
    k AS (SELECT *, p * m / (m - dr + 1) AS raw FROM r)
    SELECT lib, id, round(least(1.0, min(raw) OVER (PARTITION BY lib ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q FROM k""",
)
def _(x):
    t = x.table("part").selectExpr("p_partkey AS id", "p_brand AS lib", "((p_partkey * 7919 + p_size * 31) % 1000 + 1) / 1001.0D AS p")
    return _r(H.bh_fdr(t, by=["lib"]).select("lib", "id", "q"))


_NCP = "effect * sqrt(n / 2.0)"


def _upper(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN {tails.normal_two_sided(z, 1600)} / 2 ELSE 1 - {tails.normal_two_sided(z, 1600)} / 2 END)"


@query(
    "power_t_test",
    f"""WITH t AS (SELECT p_partkey AS id, p_size AS n, 0.1::DOUBLE * (1 + p_partkey % 12) AS effect FROM part)
    SELECT id, n, round(effect, 6) AS effect, round({_upper(f"(1.959963984540054 - {_NCP})")} + {_upper(f"(1.959963984540054 + {_NCP})")}, 6) AS power, CAST(ceil(16.0 / (effect * effect)) AS BIGINT) AS n_needed FROM t""",
)
def _(x):
    t = x.table("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"), (F.lit(0.1) * (1 + F.col("p_partkey") % 12)).alias("effect"))
    return _r(H.power_t_test(t))

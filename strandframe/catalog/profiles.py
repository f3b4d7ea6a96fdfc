"""Registered queries on table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog.base import query
from strandframe.operators import profile


def _union(parts):
    return " UNION ALL ".join(parts)


_ORDERS = {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "t", "o_orderpriority": "s"}


@query(
    "column_types",
    _union(
        f"""SELECT '{c}' AS "column", CASE WHEN '{k}' = 't' THEN 'datetime' WHEN '{k}' = 'n' AND count(DISTINCT {c}) <= 2 AND bool_and({c}::VARCHAR IN ('0', '1')) THEN 'boolean'
        WHEN '{k}' = 'n' AND count(DISTINCT {c}) <= 7 AND bool_and(try_cast({c}::VARCHAR AS DOUBLE) % 1 = 0) THEN 'ordinal' WHEN '{k}' = 'n' THEN 'continuous'
        WHEN count(DISTINCT {c}) <= 30 AND count(DISTINCT {c}) < 0.5 * count({c}) THEN 'categorical' ELSE 'text' END AS type, count(*) AS n_total, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique FROM orders"""
        for c, k in _ORDERS.items()
    ),
)
def _(x):
    return profile.detect_column_types(x.table("orders"))


_CONT = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "profile_continuous",
    _union(
        f"""SELECT * FROM (WITH q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS md, quantile_cont({c}, 0.75) AS q3, avg({c}) AS mean, stddev_samp({c}) AS sd, count({c}) AS n, min({c}) AS mn, max({c}) AS mx FROM lineitem)
        SELECT '{c}' AS "column", any_value(n) AS n, round(any_value(mean), 4) AS mean, round(any_value(md), 4) AS median, round(any_value(sd), 4) AS sd, any_value(mn) AS min, any_value(mx) AS max,
        round(avg(pow(({c} - mean) / sd, 3)), 4) AS skewness, CASE WHEN abs(avg(pow(({c} - mean) / sd, 3))) < 0.5 THEN 'approximately symmetric' WHEN abs(avg(pow(({c} - mean) / sd, 3))) < 1 THEN 'moderately skewed' ELSE 'highly skewed' END AS skew_label,
        count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers_iqr, round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS outlier_lo, round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS outlier_hi,
        any_value(mn > 0 AND mx / greatest(mn, 1e-300) > 100) AS needs_log_axis FROM lineitem, q)"""
        for c in _CONT
    ),
)
def _(x):
    p = profile.profile_continuous(x.table("lineitem"), _CONT)
    return p.select(*[F.round(c, 4).alias(c) if c in ("mean", "median", "sd", "skewness", "outlier_lo", "outlier_hi") else c for c in p.columns])


@query(
    "profile_categorical",
    _union(
        f"""SELECT '{c}' AS "column", sum(c)::BIGINT AS n, count(*) AS n_unique, min(c) AS min_group_n, max(c) AS max_group_n, min(c) < 10 AS small_groups_flag FROM (SELECT {c}, count(*) AS c FROM orders WHERE {c} IS NOT NULL GROUP BY 1)"""
        for c in ("o_orderstatus", "o_orderpriority")
    ),
)
def _(x):
    return profile.profile_categorical(x.table("orders"))


@query("profile_datetime", """SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max FROM orders""")
def _(x):
    return profile.profile_datetime(x.table("orders"), ["o_orderdate"])


@query(
    "missing_rates",
    """WITH j AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) """
    + _union(f"""SELECT '{c}' AS "column", count(*) AS n_total, count(*) - count({c}) AS n_null, round((count(*) - count({c})) / count(*), 6) AS missing_rate, (count(*) - count({c})) / count(*) > 0.2 AS missing_warning FROM j""" for c in ("doc_id", "quality", "toxic")),
)
def _(x):
    joined = x.table("documents").select("doc_id").join(x.table("labels"), "doc_id", "left")
    return profile.missing_rates(joined).withColumn("missing_rate", F.round("missing_rate", 6))


_GRADE = "CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate' WHEN abs(r) < 0.7 THEN 'strong' ELSE 'very strong' END"


@query(
    "correlation_pairs",
    f"SELECT a, b, round(r, 6) AS r, {_GRADE} AS magnitude FROM ("
    + _union(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")))
    + ") t",
)
def _(x):
    return profile.correlation_pairs(x.table("lineitem"), _CONT).withColumn("r", F.round("r", 6))


@query(
    "group_summary",
    """WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
    SELECT count(*) AS n_groups, min(n) AS min_n_per_group, max(n) AS max_n_per_group, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median_n_per_group, min(n) < 10 AS small_groups_flag, min(n) < 3 AS tiny_groups_flag FROM g""",
)
def _(x):
    return profile.group_summary(x.table("orders"), ["o_orderstatus", "o_orderpriority"])


@query("top_group_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL ORDER BY 1, 2 LIMIT 20")
def _(x):
    return profile.top_group_counts(x.table("orders"), ["o_orderstatus", "o_orderpriority"])


_TYPES = "t(c, k) AS (VALUES ('o_orderkey', 'c'), ('o_custkey', 'c'), ('o_totalprice', 'c'), ('o_orderstatus', 'g'), ('o_orderpriority', 'g'), ('o_orderdate', 't'))"


@query(
    "chart_suggestions",
    f"""WITH {_TYPES} SELECT 'histogram' AS chart, c AS x, NULL AS y FROM t WHERE k = 'c' UNION ALL SELECT 'bar', c, NULL FROM t WHERE k = 'g'
    UNION ALL SELECT 'violin', g.c, t.c FROM t JOIN t g ON t.k = 'c' AND g.k = 'g' UNION ALL SELECT 'line', g.c, t.c FROM t JOIN t g ON t.k = 'c' AND g.k = 't'
    UNION ALL SELECT 'scatter', a.c, b.c FROM t a JOIN t b ON a.k = 'c' AND b.k = 'c' AND a.c < b.c""",
)
def _(x):
    return profile.chart_suggestions(x.table("orders"))


@query(
    "profile_report",
    _union(
        f"""SELECT '{c}' AS "column", printf('| %s | %s | %d | %.1f%% | %d |', '{c}', '{k}', count(*), (count(*) - count({c})) / count(*) * 100, count(DISTINCT {c})) AS line FROM customer"""
        for c, k in (("c_custkey", "continuous"), ("c_name", "text"), ("c_nationkey", "continuous"), ("c_acctbal", "continuous"), ("c_mktsegment", "categorical"))
    ),
)
def _(x):
    return profile.render_report(x.table("customer"))


@query("label_codes", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def _(x):
    return profile.label_codes(x.table("customer"), "c_mktsegment").select("c_custkey", "code")

"""Hypothesis tests on long data (group column, value column).

Statistics come from aggregates and mid-ranks in Spark; tail probabilities are
column expressions on the few result rows.  ``by`` columns repeat a test per key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import distributions as D
from strandframe.functions.discrete import fisher_two_sided
from strandframe.plans import scan
from strandframe.plans.storage import spread_rows


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, sd, exact median and error-bar columns per group (null and NaN values left out)."""
    base = scan.present(df, value)
    moments = base.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    med = scan.exact_quantiles(base, [group], value, {"median": 0.5})
    sem = F.col("sd") / F.sqrt("n")
    return moments.join(med, group).withColumn("sem", sem).withColumn("ci_low", F.col("mean") - 1.96 * sem).withColumn("ci_high", F.col("mean") + 1.96 * sem)


def _two(df: DataFrame, group: str, value: str, a, b, by: Sequence[str]) -> DataFrame:
    first, second = F.when(F.col(group) == F.lit(a), F.col(value)), F.when(F.col(group) == F.lit(b), F.col(value))
    return df.groupBy(*by).agg(
        F.count(first).alias("n1"), F.avg(first).alias("m1"), F.var_samp(first).alias("v1"),
        F.count(second).alias("n2"), F.avg(second).alias("m2"), F.var_samp(second).alias("v2"),
    )


def ttest(df: DataFrame, group: str, value: str, a, b, equal_var: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Independent two-sample t test, pooled or Welch; Cohen's d in both definitions."""
    s = _two(df, group, value, a, b, by)
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    if equal_var:
        se, dof = F.sqrt(pooled * (1 / n1 + 1 / n2)), (n1 + n2 - 2).cast("double")
    else:
        u1, u2 = v1 / n1, v2 / n2
        se, dof = F.sqrt(u1 + u2), (u1 + u2) * (u1 + u2) / (u1 * u1 / (n1 - 1) + u2 * u2 / (n2 - 1))
    diff = F.col("m1") - F.col("m2")
    out = s.where((n1 > 1) & (n2 > 1) & (v1 + v2 > 0)).select(
        *by, "n1", "n2", (diff / se).alias("t"), dof.alias("dof"),
        (diff / F.sqrt((v1 + v2) / 2)).alias("cohens_d"), (diff / F.sqrt(pooled)).alias("cohens_d_pooled"),
    )
    return out.withColumn("p", D.t_two_sided(F.col("t"), F.col("dof")))


def ttest_paired(df: DataFrame, before: str, after: str, by: Sequence[str] = ()) -> DataFrame:
    d = F.col(before) - F.col(after)
    s = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd"))
    out = s.where((F.col("n") > 1) & (F.col("_sd") > 0)).withColumn("t", F.col("mean_diff") / (F.col("_sd") / F.sqrt("n"))).withColumn("dof", (F.col("n") - 1).cast("double"))
    return out.drop("_sd").withColumn("p", D.t_two_sided(F.col("t"), F.col("dof")))


def _exact_u(u: Column, n1: Column, n2: Column) -> Column:
    """Exact two-sided p of U for small tie-free groups (one result row)."""

    @F.pandas_udf("double")
    def exact(us: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for uu, x, y in zip(us, a.astype(int), b.astype(int)):
            ways = np.zeros(x * y + 1)
            ways[0] = 1.0
            x, y = min(x, y), max(x, y)
            for i in range(1, x + 1):
                ways[y + i :] = ways[y + i :] - ways[: max(len(ways) - y - i, 0)]
                # running sums with stride i
                padded = np.append(ways, np.zeros(-len(ways) % i)).reshape(-1, i)
                ways = padded.cumsum(axis=0).ravel()[: len(ways)]
            top = int(np.ceil(max(uu, x * y - uu)))
            out.append(min(1.0, 2 * ways[top:].sum() / ways.sum()))
        return pd.Series(out)

    return exact(u, n1, n2)


def mann_whitney(df: DataFrame, group: str, value: str, a, b, exact: bool = False) -> DataFrame:
    """Two-sided rank-sum test; U belongs to group ``a``.

    Normal form with tie and continuity correction; ``exact`` counts the null
    distribution and is meant for tie-free groups of which one has at most 8.
    """
    ga, gb = F.col(group) == F.lit(a), F.col(group) == F.lit(b)
    pre = (
        scan.present(df, value).where(ga | gb)
        .groupBy(value)
        .agg(F.sum(ga.cast("long")).alias("_na"), F.count(F.lit(1)).alias("_n"))
    )
    ranked = scan.running(scan.value_block(pre, value), [], [value], "_block", [("_less", "_n", "sum", "before")])
    n = F.col("_n").cast("double")
    s = ranked.agg(
        F.sum("_na").alias("n1"),
        (F.sum("_n") - F.sum("_na")).alias("n2"),
        F.sum(F.col("_na") * (F.col("_less") + (n + 1) / 2)).alias("_r1"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.try_divide(F.col("_ties"), total * (total - 1))))
    # all values tied: no spread, U at its mean, z 0 and p 1
    z = F.when(spread > 0, F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, spread)).when((n1 > 0) & (n2 > 0), F.lit(0.0))
    out = s.select("n1", "n2", u.alias("u"), z.alias("z"))
    p = _exact_u(F.col("u"), F.col("n1"), F.col("n2")) if exact else F.least(F.lit(1.0), 2 * D.normal_upper(F.col("z")))
    return out.withColumn("p", p)


def anova_oneway(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """F test of equal means with eta squared."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v")
    )
    s = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.sum(F.col("n") * F.col("m")).alias("sx"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sxx"),
    )
    ssb = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    out = s.withColumn("ssb", ssb).where((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("ssw") > 0))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    out = out.select(
        *by, "k", "n", d1.alias("df_between"), d2.alias("df_within"), ((F.col("ssb") / d1) / (F.col("ssw") / d2)).alias("f"),
        (F.col("ssb") / (F.col("ssb") + F.col("ssw"))).alias("eta_squared"),
    )
    return out.withColumn("p", D.f_upper(F.col("f"), F.col("df_between"), F.col("df_within")))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected count of every occurring cell."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("observed"))
    rows = cells.groupBy(a).agg(F.sum("observed").alias("row_total"))
    cols = cells.groupBy(b).agg(F.sum("observed").alias("col_total"))
    # one row, so the broadcast is bounded
    grand = cells.agg(F.sum("observed").alias("total"))
    joined = cells.join(rows, a).join(cols, b).join(F.broadcast(grand), F.lit(True))
    return joined.withColumn("expected", F.col("row_total") * F.col("col_total") / F.col("total"))


def chi2_contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-squared; Yates continuity correction when the table is 2 x 2.

    Cells that never occur add their expected count, which the form
    sum(O^2/E) - N covers without listing them.
    """
    c = contingency(df, a, b)
    s = c.agg(
        F.count_distinct(a).alias("n_rows"), F.count_distinct(b).alias("n_cols"), F.max("total").alias("n"),
        F.sum(F.col("observed") * F.col("observed") / F.col("expected")).alias("_oe"),
        F.max(F.abs(F.col("observed") - F.col("expected"))).alias("_delta"),
        F.max("row_total").alias("_r"), F.max("col_total").alias("_c"),
    )
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    n, r, k = F.col("n").cast("double"), F.col("_r").cast("double"), F.col("_c").cast("double")
    fixed = F.greatest(F.lit(0.0), F.col("_delta") - 0.5)
    yates = fixed * fixed * n * n * n / (r * (n - r) * k * (n - k))
    out = s.select("n", dof.cast("double").alias("dof"), F.when(dof == 1, yates).otherwise(F.col("_oe") - n).alias("chi2"))
    return out.withColumn("p", F.when(F.col("dof") > 0, D.chi2_upper(F.col("chi2"), F.col("dof"))).otherwise(F.lit(1.0)))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rank test of several groups with tie correction; fewer than two groups or all values tied: null h and p."""
    clean = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    cells = clean.groupBy(value, group).agg(F.count(F.lit(1)).alias("_c"))
    ranks = scan.midranks(clean, [], value)
    joined = cells.join(ranks.select(value, "midrank"), value)
    per = joined.groupBy(group).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("midrank")).alias("r"))
    t = F.col("n_ties").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t).alias("_ties"))
    s = per.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("_rr")).join(F.broadcast(ties), F.lit(True))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("_rr") - 3 * (n + 1)
    h = F.when(F.col("k") > 1, F.try_divide(raw, 1 - F.try_divide(F.col("_ties"), n * n * n - n)))
    out = s.where("k > 0").select("k", "n", h.alias("h"), (F.col("k") - 1).cast("double").alias("dof"))
    return out.withColumn("p", D.chi2_upper(F.col("h"), F.col("dof")))


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Homogeneity of variance: ANOVA on distances from the group median."""
    med = scan.exact_quantiles(df, [group], value, {"_med": 0.5})
    spread = df.join(med, group).withColumn("_z", F.abs(F.col(value) - F.col("_med")))
    return anova_oneway(spread, group, "_z").drop("eta_squared")


def fisher_exact(tables: DataFrame) -> DataFrame:
    """Two-sided p and odds ratio for rows with counts ``a, b, c, d``, of any size.

    p adds all tables of the same margins that are no more probable; the odds
    ratio is null where b or c is 0.
    """
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    odds = F.when(b * c > 0, a * d / F.nullif(b * c, F.lit(0.0)))
    return spread_rows(tables).select(*tables.columns, odds.alias("odds_ratio"), fisher_two_sided(a, b, c, d).alias("p"))


def _r_test(n: Column, r: Column) -> Column:
    t = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    return D.t_two_sided(t, n - 2)


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r")).where((F.col("n") > 2) & F.col("r").isNotNull())
    return out.withColumn("p", _r_test(F.col("n"), F.col("r")))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of mid-ranks; equal (x, y) pairs are counted first."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    rx = scan.midranks(both, [], x).select(x, F.col("midrank").alias("_rx"))
    ry = scan.midranks(both, [], y).select(y, F.col("midrank").alias("_ry"))
    cells = both.groupBy(x, y).agg(F.count(F.lit(1)).cast("double").alias("w")).join(rx, x).join(ry, y)
    w, u, v = F.col("w"), F.col("_rx"), F.col("_ry")
    s = cells.agg(F.sum("w").alias("n"), F.sum(w * u).alias("su"), F.sum(w * v).alias("sv"), F.sum(w * u * u).alias("suu"), F.sum(w * v * v).alias("svv"), F.sum(w * u * v).alias("suv"))
    n = F.col("n")
    r = (n * F.col("suv") - F.col("su") * F.col("sv")) / F.sqrt((n * F.col("suu") - F.col("su") * F.col("su")) * (n * F.col("svv") - F.col("sv") * F.col("sv")))
    out = s.select(n.cast("long").alias("n"), r.alias("r")).where(F.col("n") > 2)
    return out.withColumn("p", _r_test(F.col("n"), F.col("r")))


def _place_in_group(df: DataFrame, group: str, order: Sequence[str], out: str) -> DataFrame:
    """One-based place of every row inside its group and the group's row count ``_n``."""
    placed = scan.row_positions(df, [F.col(c).asc() for c in (group, *order)], "_at")
    sizes = placed.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    return placed.join(sizes, group).withColumn(out, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")


def shapiro(df: DataFrame, group: str, value: str, order: str | None = None, first: int | None = 5000) -> DataFrame:
    """Shapiro-Wilk per group of three or more values (Royston 1995).

    With ``order`` a group is judged by its first ``first`` rows in that order;
    without it, or with ``first=None``, by all its rows.  ``order`` must not be
    the value itself, whose first rows would be the smallest ones.  Ranks come
    from range partitions, so a large group is no single task.
    """
    if order == value:
        raise ValueError("order rows by a column other than the tested value")
    head = scan.present(df, value).where(F.col(group).isNotNull())
    if order is not None and first is not None:
        placed = _place_in_group(head.select(group, value, order), group, [order, value], "_o")
        head = placed.where(F.col("_o") <= first)
    head = head.select(group, F.col(value).cast("double").alias("_x"))
    ranked = _place_in_group(head, group, ["_x"], "_i").where(F.col("_n") >= 3)
    m = ranked.withColumn("_m", D.normal_quantile((F.col("_i") - 0.375) / (F.col("_n") + 0.25)))
    sums = m.groupBy(group).agg(
        F.max("_n").alias("n"), F.sum(F.col("_m") * F.col("_m")).alias("_mm"), F.max(F.when(F.col("_i") == F.col("_n"), F.col("_m"))).alias("_m1"),
        F.max(F.when(F.col("_i") == F.col("_n") - 1, F.col("_m"))).alias("_m2"), F.var_pop("_x").alias("_v"),
    ).where(F.col("_v") > 0)
    n, mm = F.col("n").cast("double"), F.col("_mm")
    rsn = 1 / F.sqrt(n)

    def poly(cs: Sequence[float], t: Column) -> Column:
        out = F.lit(cs[-1])
        for cc in reversed(cs[:-1]):
            out = out * t + cc
        return out

    # Royston's polynomial coefficients.
    a1 = poly((0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), rsn) + F.col("_m1") / F.sqrt(mm)
    a2 = poly((0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), rsn) + F.col("_m2") / F.sqrt(mm)
    large = (mm - 2 * F.col("_m1") ** 2 - 2 * F.col("_m2") ** 2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    small = (mm - 2 * F.col("_m1") ** 2) / (1 - 2 * a1 * a1)
    coef = sums.withColumn("_a1", a1).withColumn("_a2", a2).withColumn("_phi", F.when(n > 5, large).otherwise(small))
    i, k = F.col("_i"), F.col("_n")
    mid = F.col("_m") / F.sqrt("_phi")
    weight = (
        F.when((k == 3) & (i == 2), F.lit(0.0)).when(k == 3, (i - 2) * math.sqrt(0.5))
        .when(i == k, F.col("_a1")).when(i == 1, -F.col("_a1"))
        .when((k > 5) & (i == k - 1), F.col("_a2")).when((k > 5) & (i == 2), -F.col("_a2")).otherwise(mid)
    )
    stat = m.join(coef, group).groupBy(group).agg(F.max("n").alias("n"), F.sum(weight * F.col("_x")).alias("_ax"), F.max("_v").alias("_v"))
    out = stat.select(group, "n", (F.col("_ax") ** 2 / (F.col("n") * F.col("_v"))).alias("w"))
    ln = F.log(n)
    y = F.log(F.greatest(1 - F.col("w"), F.lit(1e-300)))
    big_z = (y - poly((-1.5861, -0.31082, -0.083751, 0.0038915), ln)) / F.exp(poly((-0.4803, -0.082676, 0.0030302), ln))
    gamma = poly((-2.273, 0.459), n)
    low_z = (-F.log(F.greatest(gamma - y, F.lit(1e-300))) - poly((0.544, -0.39978, 0.025054, -6.714e-4), n)) / F.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    # three values: the distribution of W is known in closed form
    three = F.lit(6 / math.pi) * (F.asin(F.sqrt(F.least(F.lit(1.0), F.col("w")))) - math.asin(math.sqrt(0.75)))
    spread = D.normal_upper(F.when(n >= 12, big_z).otherwise(low_z))
    return out.withColumn("p", F.when(n == 3, F.greatest(F.lit(0.0), three)).otherwise(spread))


def shown_p(p: Column) -> Column:
    """Below 0.001 three significant digits, otherwise four decimals."""
    tiny = F.format_string("%.2e", p).cast("double")
    return F.when(p < 0.001, tiny).otherwise(F.round(p, 4))


def _two_groups(df: DataFrame, group: str, value: str, names: Sequence) -> DataFrame:
    return df.where(F.col(value).isNotNull() & F.col(group).isin(*names))


def stats_test(df: DataFrame, group: str, value: str, test: str = "auto", order: str | None = None) -> DataFrame:
    """Pick and run a group comparison: test, statistic, p, p_value, significant, effect_size, group_stats, n_groups, n_total.

    ``auto``: two groups get a t test when every group of more than two passes
    Shapiro-Wilk at 0.05, otherwise Mann-Whitney; more groups get ANOVA.  Only
    the per-group result rows are looked at to decide.  The normality check
    takes the first 5000 rows of a group in ``order``, all rows without it.
    Mann-Whitney is exact when the smaller group has at most 8 values and none are tied.

    ``effect_size`` is Cohen's d (first group minus second, in order of name) of
    two-group tests, otherwise null.  ``group_stats`` lists group, n, mean, std and
    median per group, null for chi-squared.  ``n_total`` counts all rows.
    """
    known = df.where(F.col(group).isNotNull())
    sizes = df.agg(F.count(F.lit(1)).alias("n_total"), F.count_distinct(group).alias("n_groups"))
    effect, described = None, None
    if test == "chi2":
        found = chi2_contingency(df, group, value).select(F.lit("Chi-squared").alias("test"), F.col("chi2").alias("statistic"), "p")
    else:
        names = [r[0] for r in known.select(group).distinct().orderBy(group).limit(3).collect()]
        if len(names) < 2:
            raise ValueError(f"need at least 2 groups, found {len(names)}")
        if test == "auto":
            if len(names) == 2:
                bad = shapiro(df, group, value, order).where(F.col("p") <= 0.05).limit(1).count()
                test = "mannwhitney" if bad else "ttest"
            else:
                test = "anova"
        if test in ("ttest", "mannwhitney") and len(names) != 2:
            raise ValueError(f"invalid test: {test} for more than 2 groups")
        if test == "ttest":
            found = ttest(df, group, value, *names).select(F.lit("Independent t-test").alias("test"), F.col("t").alias("statistic"), "p", "cohens_d")
        elif test == "mannwhitney":
            clean = _two_groups(df, group, value, names)
            exact = clean.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least")).first()["least"] <= 8
            if exact:
                exact = clean.groupBy(value).count().where("count > 1").limit(1).count() == 0
            found = mann_whitney(df, group, value, *names, exact=exact).select(F.lit("Mann-Whitney U").alias("test"), F.col("u").alias("statistic"), "p")
            found = found.join(F.broadcast(ttest(df, group, value, *names).select("cohens_d")), F.lit(True))
        elif test == "anova":
            found = anova_oneway(df, group, value).select(F.lit("One-way ANOVA").alias("test"), F.col("f").alias("statistic"), "p")
        else:
            raise ValueError(f"unknown test: {test}")
        effect = F.col("cohens_d") if "cohens_d" in found.columns else None
        per = group_stats(known, group, value).select(F.struct(F.col(group).cast("string").alias("group"), "n", "mean", F.col("sd").alias("std"), "median").alias("g"))
        described = per.agg(F.array_sort(F.collect_list("g")).alias("group_stats"))
    shape = "array<struct<group:string,n:bigint,mean:double,std:double,median:double>>"
    out = found.join(F.broadcast(sizes), F.lit(True))
    out = out.join(F.broadcast(described), F.lit(True)) if described is not None else out.withColumn("group_stats", F.lit(None))
    return out.select(
        "test", "statistic", "p", shown_p(F.col("p")).alias("p_value"), (F.col("p") < 0.05).alias("significant"),
        (F.lit(None).cast("double") if effect is None else effect).alias("effect_size"), F.col("group_stats").cast(shape).alias("group_stats"), "n_groups", "n_total",
    )


def bonferroni(df: DataFrame, p: str = "p", by: Sequence[str] = (), out: str = "p_adjusted") -> DataFrame:
    if by:
        m = df.where(F.col(p).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
        joined = df.join(m, list(by), "left")
    else:
        m = df.agg(F.count(p).alias("_m"))
        joined = df.join(F.broadcast(m), F.lit(True))
    return joined.withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("_m"))).drop("_m")


def _p_block(p: Column) -> Column:
    """Block of a probability: even steps above 1/4096, logarithmic ones below."""
    small = 1024 - F.least(F.lit(1023), F.floor(-F.log(F.greatest(p, F.lit(1e-300)))))
    return F.when(p >= 1 / 4096, 1024 + F.floor(p * 4096)).otherwise(small).cast("int")


def bh_fdr(df: DataFrame, p: str = "p", by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """Benjamini-Hochberg: min over p' >= p of p' * m / rank(p'), at most 1.

    Works on distinct p values in blocks, so millions of tests are no single task.
    """
    by = list(by)
    pre = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", _p_block(F.col(p)))
    ranked = scan.running(pre, by, [p], "_block", [("_rank", "_n", "sum", "upto"), ("_rest", "_n", "sum", "after")])
    raw = ranked.withColumn("_raw", F.col(p) * (F.col("_rank") + F.col("_rest")) / F.col("_rank"))
    best = scan.running(raw.select(*by, p, "_block", "_raw"), by, [p], "_block", [("_best", "_raw", "min", "onward")])
    q = best.select(*by, p, F.least(F.lit(1.0), F.col("_best")).alias(out))
    return df.join(q, [*by, p], "left")


def power_t_test(df: DataFrame, n: str = "n", effect: str = "effect", alpha: float = 0.05) -> DataFrame:
    """Power of a two-sided two-sample test (normal form) and n per group of 16/d^2."""
    ncp = F.col(effect) * F.sqrt(F.col(n) / 2)
    crit = NormalDist().inv_cdf(1 - alpha / 2)
    power = D.normal_upper(F.lit(crit) - ncp) + D.normal_upper(F.lit(crit) + ncp)
    return df.withColumn("power", power).withColumn("n_needed", F.ceil(F.lit(16.0) / (F.col(effect) * F.col(effect))))

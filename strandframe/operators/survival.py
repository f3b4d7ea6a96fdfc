"""Survival analysis on rows with ``time`` and ``event`` (0/1)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import distributions as D
from strandframe.operators import hypothesis
from strandframe.plans import scan

_SPAN = 1 << 14


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows with a positive time and a 0/1 event."""
    return df.where((F.col("time") > 0) & F.col("event").isin(0, 1))


def censoring_rate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"), (1 - F.avg("event")).alias("censored"))


def median_split(df: DataFrame, value: str, out: str = "group") -> DataFrame:
    """High for values at or above the exact median, else Low."""
    med = scan.exact_quantiles(df, [], value, {"_med": 0.5})
    return df.join(F.broadcast(med), F.lit(True)).withColumn(out, F.when(F.col(value) >= F.col("_med"), "High").otherwise("Low")).drop("_med")


def kaplan_meier(df: DataFrame, group: str) -> DataFrame:
    """Survival curve per group at its observed times, with the at-risk count.

    Rows are first counted per time, so a large group is a short table.
    """
    per = df.groupBy(group, "time").agg(F.sum("event").alias("deaths"), F.count(F.lit(1)).alias("leaving")).withColumn("_block", scan.width_block("time", _SPAN))
    risk = scan.running(per, [group], ["time"], "_block", [("at_risk", "leaving", "sum", "onward")])
    everyone = F.col("deaths") == F.col("at_risk")
    steps = risk.withColumn("_ln", F.when(everyone, F.lit(0.0)).otherwise(F.log1p(-F.col("deaths") / F.col("at_risk")))).withColumn("_zero", everyone.cast("int"))
    curve = scan.running(steps, [group], ["time"], "_block", [("_sum", "_ln", "sum", "upto"), ("_dead", "_zero", "max", "upto")])
    return curve.select(
        group, "time", "deaths", (F.col("leaving") - F.col("deaths")).alias("censored"), "at_risk",
        F.when(F.col("_dead") == 1, F.lit(0.0)).otherwise(F.exp("_sum")).alias("survival"),
    )


def median_survival(curve: DataFrame, group: str) -> DataFrame:
    """First time with survival at or below one half, null when never reached."""
    return curve.groupBy(group).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_time"))


def logrank(df: DataFrame, group: str, a, b) -> DataFrame:
    """Two-group log-rank test over the event times (one row)."""
    ga = F.col(group) == F.lit(a)
    per = (
        df.where(ga | (F.col(group) == F.lit(b)))
        .groupBy("time")
        .agg(F.sum("event").alias("d"), F.sum(F.when(ga, F.col("event")).otherwise(0)).alias("d1"), F.count(F.lit(1)).alias("l"), F.sum(ga.cast("long")).alias("l1"))
        .withColumn("_block", scan.width_block("time", _SPAN))
    )
    r = scan.running(per, [], ["time"], "_block", [("n", "l", "sum", "onward"), ("n1", "l1", "sum", "onward")]).where(F.col("d") > 0)
    n, n1, d = (F.col(c).cast("double") for c in ("n", "n1", "d"))
    s = r.agg(
        F.sum("d1").alias("observed"), F.sum(d * n1 / n).alias("expected"),
        F.sum(F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / F.greatest(n - 1, F.lit(1.0))).otherwise(F.lit(0.0))).alias("variance"),
    )
    diff = F.col("observed") - F.col("expected")
    return s.withColumn("chi2", F.try_divide(diff * diff, F.col("variance"))).withColumn("p", D.chi2_upper(F.col("chi2"), F.lit(1.0)))


def _risk_sets(df: DataFrame, covars: Sequence[str], beta: Sequence[float]) -> DataFrame:
    """Per event time: deaths, covariate sums of the deaths and risk-set moments."""
    p = len(covars)
    score: Column = F.lit(0.0)
    for c, b in zip(covars, beta):
        score = score + F.col(c) * F.lit(float(b))
    w = F.exp(score)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    per = df.groupBy("time").agg(
        F.sum("event").alias("d"), F.sum(w).alias("w"),
        *[F.sum(w * F.col(c)).alias(f"w{i}") for i, c in enumerate(covars)],
        *[F.sum(w * F.col(covars[i]) * F.col(covars[j])).alias(f"w{i}_{j}") for i, j in pairs],
        *[F.sum(F.col("event") * F.col(c)).alias(f"x{i}") for i, c in enumerate(covars)],
        F.sum(F.col("event") * score).alias("e"),
    ).withColumn("_block", scan.width_block("time", _SPAN))
    specs = [("s", "w", "sum", "onward"), *[(f"s{i}", f"w{i}", "sum", "onward") for i in range(p)], *[(f"s{i}_{j}", f"w{i}_{j}", "sum", "onward") for i, j in pairs]]
    return scan.running(per, [], ["time"], "_block", specs).where(F.col("d") > 0)


def cox_ph(df: DataFrame, covars: Sequence[str], penalizer: float = 0.01, rounds: int = 20, tolerance: float = 1e-7) -> DataFrame:
    """Proportional hazards fit (Breslow ties) by Newton steps.

    Maximises log likelihood / n - penalizer / 2 * |beta|^2 on covariates
    centred at their means.  Every round is one aggregation over the table;
    only the p gradient and p x p Hessian sums reach the driver.
    """
    import numpy as np

    covars = list(covars)
    p = len(covars)
    means = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in covars]).first()
    n = means["n"]
    base = df.select("time", "event", *[(F.col(c) - float(means[c])).alias(c) for c in covars])
    beta = np.zeros(p)
    hess = np.eye(p)
    for _ in range(rounds):
        r = _risk_sets(base, covars, beta)
        s, d = F.col("s"), F.col("d")
        out = r.agg(
            *[F.sum(F.col(f"x{i}") - d * F.col(f"s{i}") / s).alias(f"g{i}") for i in range(p)],
            *[F.sum(d * (F.col(f"s{i}_{j}") / s - F.col(f"s{i}") * F.col(f"s{j}") / (s * s))).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)],
        ).first()
        grad = np.array([out[f"g{i}"] for i in range(p)]) - n * penalizer * beta
        hess = np.array([[out[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) + n * penalizer * np.eye(p)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.max(np.abs(step)) < tolerance:
            break
    se = np.sqrt(np.diag(np.linalg.inv(hess)))
    rows = [(c, float(b), float(e)) for c, b, e in zip(covars, beta, se)]
    fit = df.sparkSession.createDataFrame(rows, "covariate string, coef double, se double")
    z = F.col("coef") / F.col("se")
    return fit.select(
        "covariate", "coef", "se", F.exp("coef").alias("hazard_ratio"), F.exp(F.col("coef") - 1.959963984540054 * F.col("se")).alias("ci_low"),
        F.exp(F.col("coef") + 1.959963984540054 * F.col("se")).alias("ci_high"), z.alias("z"), D.normal_two_sided(z).alias("p"),
    )


def coefficients(fit: DataFrame) -> dict[str, float]:
    """Coefficients of a fit, one per covariate."""
    return {r["covariate"]: r["coef"] for r in fit.select("covariate", "coef").collect()}


def schoenfeld_test(df: DataFrame, beta: dict[str, float]) -> DataFrame:
    """Correlation of Schoenfeld residuals with time, per covariate."""
    covars = list(beta)
    r = _risk_sets(df, covars, [beta[c] for c in covars])
    expected = r.select("time", *[(F.col(f"s{i}") / F.col("s")).alias(f"_m{i}") for i in range(len(covars))])
    events = df.where(F.col("event") == 1).join(expected, "time")
    long = events.select(
        "time", F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), (F.col(c) - F.col(f"_m{i}")).alias("residual")) for i, c in enumerate(covars)])).alias("r")
    ).select(F.col("time").cast("double").alias("time"), "r.covariate", "r.residual")
    return hypothesis.pearson(long, "time", "residual", by=["covariate"])


def linear_risk(df: DataFrame, beta: dict[str, float], out: str = "risk") -> DataFrame:
    score: Column = F.lit(0.0)
    for c, b in beta.items():
        score = score + F.col(c) * F.lit(b)
    return df.withColumn(out, score)


#: Rows of a time or risk block, and blocks of an axis, at least and at most.
_BLOCK_ROWS, _MOST_BLOCKS = 1 << 16, 1 << 12


def later_and_smaller(t: np.ndarray, r: np.ndarray, members: np.ndarray, asked: np.ndarray) -> tuple[int, int]:
    """Sum over rows of ``asked`` times the ``members`` at a later t with a smaller r, and with an equal r.

    Chunks of whole t values are taken from the last; rows after a chunk are a
    histogram over r, rows inside it are compared with each other.
    """
    order = np.argsort(t, kind="stable")
    t, members, asked = t[order], members[order], asked[order]
    rank = np.unique(r, return_inverse=True)[1][order]
    starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    later = np.zeros(int(rank.max()) + 2, np.int64)  # members by rank, one place on
    chunk = max(256, math.isqrt(len(t)))
    smaller = equal = 0
    end = len(t)
    while end:
        last = int(starts[np.searchsorted(starts, end) - 1])
        # values that start within a chunk, or one longer value alone
        begin = min(last, int(starts[np.searchsorted(starts, max(end - chunk, 0))])) if last > end - chunk else last
        k, a, m = rank[begin:end], asked[begin:end], members[begin:end]
        smaller += int(a @ np.cumsum(later)[k])
        equal += int(a @ later[k + 1])
        if begin < last:
            after = t[begin:end] > t[begin:end, None]
            smaller += int(a @ ((after & (k < k[:, None])) @ m))
            equal += int(a @ ((after & (k == k[:, None])) @ m))
        np.add.at(later, k + 1, m)
        end = begin
    return smaller, equal


def _strips(rows: DataFrame, block: str, t: str) -> DataFrame:
    """Concordant and tied pairs inside every ``block``, compared by ``t``."""
    def count(frame: pd.DataFrame) -> pd.DataFrame:
        found = later_and_smaller(*(frame[c].to_numpy() for c in (t, "_r", "_c", "_d")))
        return pd.DataFrame([found], columns=["concordant", "tied"])

    used = rows.select(block, *({t, "_r", "_c", "_d"} - {block}))
    return used.groupBy(block).applyInPandas(count, "concordant long, tied long")


def concordance_index(df: DataFrame, risk: str) -> DataFrame:
    """Share of comparable pairs whose earlier failure has the higher risk.

    A pair is comparable when the earlier time is an event (an event also
    precedes a censoring at the same time); equal risks count one half.

    Times and risks are cut into blocks of rank.  Pairs of different time and
    different risk blocks come from a matrix of block counts by sums along both
    axes; pairs of one time block, and pairs of one risk block in different time
    blocks, are counted inside the block.  A value that fills more than a block has
    its own, where nothing is left to compare.  No valid row: counts 0, null index.
    """
    clean = scan.present(df.where("time is not null and event is not null"), risk)
    total = clean.count()
    width = max(_BLOCK_ROWS, -(-total // _MOST_BLOCKS))
    frequent = F.col("n_ties") > width
    late = 1 - F.col("event").cast("long")
    times = scan.midranks(clean, [], "time").select("time", F.col("n_less").cast("long").alias("_before"), frequent.alias("_often"))
    risks = scan.midranks(clean, [], risk).select(risk, F.col("n_less").cast("long").alias("_r"), (F.floor(F.col("n_less") / width) * 2 + frequent.cast("long")).cast("long").alias("_rb"))
    time_block = F.floor(F.col("_before") / width) * 3 + F.when(F.col("_often"), 1 + late).otherwise(0)
    placed = clean.join(times, "time").join(risks, risk)
    rows = placed.groupBy(time_block.cast("long").alias("_tb"), (F.col("_before") * 2 + late).alias("_t"), "_rb", "_r").agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.col("event").cast("long")).alias("_d")
    )
    rows = scan.cut_lineage(rows)

    cells = rows.groupBy("_tb", "_rb").agg(F.sum("_c").alias("_c"), F.sum("_d").alias("_d"))
    # at most a few _MOST_BLOCKS per axis
    grid = cells.select("_tb").distinct().crossJoin(F.broadcast(cells.select("_rb").distinct())).join(cells, ["_tb", "_rb"], "left").fillna(0, ["_c", "_d"])
    zero = F.lit(0).cast("long")
    after = Window.partitionBy("_rb").orderBy(F.desc("_tb")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("_tb").orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_later", F.coalesce(F.sum("_c").over(after), zero))
    grid = grid.withColumn("_open", F.coalesce(F.sum("_later").over(below), zero))
    across = grid.select((F.col("_d") * F.col("_open")).alias("concordant"), F.when(F.col("_rb") % 2 == 1, F.col("_d") * F.col("_later")).otherwise(zero).alias("tied"))
    inside = _strips(rows.where("_tb % 3 = 0"), "_tb", "_t").unionByName(_strips(rows.where("_rb % 2 = 0"), "_rb", "_tb"))
    good = across.unionByName(inside).agg(F.coalesce(F.sum("concordant"), zero).alias("concordant"), F.coalesce(F.sum("tied"), zero).alias("tied"))
    # at one time, events are later than none of their own
    per = rows.where("_d > 0").groupBy("_t").agg(F.sum("_d").alias("_d"))
    pairs = per.agg(F.coalesce(F.sum(F.col("_d") * (total - F.floor(F.col("_t") / 2) - F.col("_d"))), zero).alias("comparable"))
    return good.join(F.broadcast(pairs), F.lit(True)).select(
        "concordant", "tied", "comparable", F.try_divide(F.col("concordant") + 0.5 * F.col("tied"), F.col("comparable")).alias("c_index")
    )


def parametric_survival(df: DataFrame, covars: Sequence[str]) -> DataFrame:
    """Weibull accelerated failure time fit, one row per coefficient."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import AFTSurvivalRegression

    rows = VectorAssembler(inputCols=list(covars), outputCol="_x").transform(
        df.select(*covars, F.col("time").cast("double").alias("label"), F.col("event").cast("double").alias("censor"))
    )
    model = AFTSurvivalRegression(featuresCol="_x").fit(rows)
    found = [(c, float(v)) for c, v in zip(covars, model.coefficients)] + [("intercept", float(model.intercept)), ("scale", float(model.scale))]
    return df.sparkSession.createDataFrame(found, "term string, estimate double")

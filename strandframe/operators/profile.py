"""Table profiling: column types, summaries, groups, chart hints.

Columns are unpivoted so that one plan serves all of them; the driver only
sees one small row per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.plans import scan

def _text_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) with every value as text, nulls kept."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")


def missing_rates(df: DataFrame, limit: float = 0.20) -> DataFrame:
    rows = _text_rows(df, df.columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(F.col("value").isNull().cast("long")).alias("n_null")
    )
    rate = F.col("n_null") / F.col("n_total")
    return rows.withColumn("missing_rate", rate).withColumn("missing_warning", rate > limit)


def detect_column_types(df: DataFrame) -> DataFrame:
    """One row per column: boolean (0/1), ordinal (<= 7 whole values),
    continuous, datetime, categorical (<= 30 values and ratio < 0.5), text, unknown.

    Text is a datetime when every non-null value parses; the result does not
    depend on row order.
    """
    kinds = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds[f.name] = "time"
        elif isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = "flag"
        elif isinstance(f.dataType, T.NumericType):
            kinds[f.name] = "number"
        elif isinstance(f.dataType, T.StringType):
            kinds[f.name] = "text"
        else:
            kinds[f.name] = "other"
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("column"))
    # counting distinct values first keeps a frequent value in one row
    values = _text_rows(df, df.columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("c")).withColumn("kind", kind)
    number = F.expr("try_cast(value AS DOUBLE)")
    is_num, is_text = F.col("kind") == "number", (F.col("kind") == "text") & F.col("value").isNotNull()
    stats = values.groupBy("column", "kind").agg(
        F.sum("c").alias("n_total"),
        F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("n_null"),
        F.count("value").alias("n_unique"),
        F.max(F.when(is_num & F.col("value").isNotNull(), (~number.isin(0.0, 1.0)).cast("int"))).alias("_beyond"),
        F.max(F.when(is_num & F.col("value").isNotNull(), (number % 1 != 0).cast("int"))).alias("_frac"),
        F.max(F.when(is_text, F.expr("try_to_timestamp(value) IS NULL").cast("int"))).alias("_plain"),
    )
    n = F.col("n_total") - F.col("n_null")
    u = F.col("n_unique")
    verdict = (
        F.when(F.col("kind") == "time", "datetime")
        .when(F.col("kind") == "flag", "boolean")
        .when((F.col("kind") == "number") & (F.coalesce("_beyond", F.lit(0)) == 0) & (u <= 2), "boolean")
        .when((F.col("kind") == "number") & (u <= 7) & (F.coalesce("_frac", F.lit(0)) == 0), "ordinal")
        .when(F.col("kind") == "number", "continuous")
        .when((F.col("kind") == "text") & (u == 0), "unknown")
        .when((F.col("kind") == "text") & (F.col("_plain") == 0), "datetime")
        .when((F.col("kind") == "text") & (u <= 30) & (u < 0.5 * n), "categorical")
        .when(F.col("kind") == "text", "text")
        .otherwise("unknown")
    )
    return stats.select("column", verdict.alias("type"), "n_total", "n_null", "n_unique")


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    """Names of the columns with one of the wanted types (one small row each)."""
    found = detect_column_types(df).where(F.col("type").isin(*wanted)).select("column").collect()
    names = {r[0] for r in found}
    return [c for c in df.columns if c in names]


def profile_continuous(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Moments, skewness over the sample deviation, IQR outliers, log-axis flag."""
    columns = list(columns or columns_of(df, "continuous"))
    if not columns:
        raise ValueError("no continuous column")
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value").where(F.col("value").isNotNull())
    q = scan.exact_quantiles(rows, ["column"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    m = rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.skewness("value").alias("_g1"),
    )
    n = F.col("n").cast("double")
    iqr = F.col("q3") - F.col("q1")
    fences = (
        m.join(q, "column")
        .withColumn("skewness", F.when(n < 3, F.lit(None)).when(F.col("sd") == 0, F.lit(0.0)).otherwise(F.col("_g1") * F.pow((n - 1) / n, F.lit(1.5))))
        .withColumn("outlier_lo", F.when(n >= 4, F.col("q1") - 1.5 * iqr))
        .withColumn("outlier_hi", F.when(n >= 4, F.col("q3") + 1.5 * iqr))
    )
    # one row per column of the table, so the broadcast is bounded
    outside = rows.join(F.broadcast(fences.select("column", "outlier_lo", "outlier_hi")), "column")
    flagged = outside.groupBy("column").agg(F.sum(((F.col("value") < F.col("outlier_lo")) | (F.col("value") > F.col("outlier_hi"))).cast("long")).alias("n_outliers_iqr"))
    a = F.abs("skewness")
    label = F.when(F.col("skewness").isNull(), "unknown").when(a < 0.5, "approximately symmetric").when(a < 1.0, "moderately skewed").otherwise("highly skewed")
    log_axis = (F.col("min") > 0) & (n >= 5) & (F.col("max") / F.greatest("min", F.lit(1e-300)) > 100)
    return fences.join(flagged, "column").select(
        "column", "n", "mean", "median", "sd", "min", "max", "skewness", label.alias("skew_label"),
        F.coalesce("n_outliers_iqr", F.lit(0)).alias("n_outliers_iqr"), "outlier_lo", "outlier_hi",
        F.coalesce(F.when(F.col("min") <= 0, F.lit(False)).otherwise(log_axis), F.lit(False)).alias("needs_log_axis"),
    )


def profile_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or columns_of(df, "categorical", "boolean", "ordinal"))
    counts = _text_rows(df, columns).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("column").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_unique"), F.min("c").alias("min_group_n"), F.max("c").alias("max_group_n"),
        (F.min("c") < 10).alias("small_groups_flag"),
    )


def profile_datetime(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or columns_of(df, "datetime"))
    rows = df.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.groupBy("column").agg(text(F.min("value")).alias("min"), text(F.max("value")).alias("max"))


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over complete rows (at least 5)."""
    columns = list(columns or columns_of(df, "continuous"))
    if len(columns) < 2:
        raise ValueError("need at least two continuous columns")
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = complete.agg(F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    listed = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    out = one.where(F.col("n") >= 5).select(listed.alias("x")).select("x.*")
    m = F.abs("r")
    grade = F.when(m < 0.1, "negligible").when(m < 0.3, "weak").when(m < 0.5, "moderate").when(m < 0.7, "strong").otherwise("very strong")
    return out.withColumn("magnitude", grade).orderBy(F.desc(F.abs("r")))


def group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group, the null group included."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def group_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    sizes = group_sizes(df, by)
    # distinct sizes are few; the percentile buffer holds size -> count only
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("min_n_per_group"), F.max("n").alias("max_n_per_group"),
        F.floor(F.percentile("n", 0.5)).alias("median_n_per_group"), (F.min("n") < 10).alias("small_groups_flag"), (F.min("n") < 3).alias("tiny_groups_flag"),
    )


def chart_suggestions(df: DataFrame) -> DataFrame:
    """Chart hints as rows, by rule over the column types and summaries.

    Rules: distribution for each continuous column, box or violin for each
    continuous x grouping pair (points shown when a group is below 10), scatter
    for continuous pairs, bars for grouping columns, lines over time.
    """
    types = detect_column_types(df)
    cont = types.where(F.col("type") == "continuous").select(F.col("column").alias("y"))
    grp = types.where(F.col("type").isin("categorical", "boolean", "ordinal")).select(F.col("column").alias("x"))
    time = types.where(F.col("type") == "datetime").select(F.col("column").alias("x"))
    sizes = profile_categorical(df).select(F.col("column").alias("x"), "small_groups_flag")
    # one row per table column on both sides
    boxes = cont.join(grp, F.lit(True)).join(sizes, "x", "left").select(
        F.when(F.col("small_groups_flag"), "strip").otherwise("violin").alias("chart"), "x", "y"
    )
    return (
        cont.select(F.lit("histogram").alias("chart"), F.col("y").alias("x"), F.lit(None).cast("string").alias("y"))
        .unionByName(boxes)
        .unionByName(grp.select(F.lit("bar").alias("chart"), "x", F.lit(None).cast("string").alias("y")))
        .unionByName(time.join(cont, F.lit(True)).select(F.lit("line").alias("chart"), "x", "y"))
        .unionByName(cont.select(F.col("y").alias("x")).join(cont, F.col("x") < F.col("y")).select(F.lit("scatter").alias("chart"), "x", "y"))
    )


def render_report(df: DataFrame) -> DataFrame:
    """One markdown table line per column."""
    t = detect_column_types(df)
    rate = F.col("n_null") / F.col("n_total") * 100
    return t.select("column", F.format_string("| %s | %s | %d | %.1f%% | %d |", "column", "type", "n_total", rate, "n_unique").alias("line"))


def top_group_counts(df: DataFrame, by: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` groups in key order with their sizes."""
    return group_sizes(df, by).orderBy(*by).limit(n)


def label_codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Sorted labels to 0..n-1; only the distinct labels are ordered, by range."""
    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = scan.row_positions(levels, [F.asc(column)], out).withColumn(out, F.col(out) - 1)
    return df.join(ranked, column, "left")

"""General table verbs of the analyses, where a DataFrame method is not enough."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.plans import scan

# Common species names and their directory names.
SPECIES = {
    "human": "homo_sapiens",
    "mouse": "mus_musculus",
    "rat": "rattus_norvegicus",
    "zebrafish": "danio_rerio",
    "fly": "drosophila_melanogaster",
    "drosophila": "drosophila_melanogaster",
    "worm": "caenorhabditis_elegans",
    "c.elegans": "caenorhabditis_elegans",
    "arabidopsis": "arabidopsis_thaliana",
    "rice": "oryza_sativa",
    "yeast": "saccharomyces_cerevisiae",
    "ecoli": "escherichia_coli",
}


def numeric_columns(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``; found by a minimum, so copies shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_m"))
    return first.select(*keys, "_m.*").select(*df.columns)


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Contingency table with one column per value of ``column``."""
    return df.groupBy(row).pivot(column).count().na.fill(0)


def transpose_long(df: DataFrame) -> DataFrame:
    """Swap the two keys of a long matrix (row_key, col_key, value)."""
    a, b, v = df.columns
    return df.select(F.col(b).alias(a), F.col(a).alias(b), v)


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace nulls by the exact column median."""
    out = df
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull())
    med = scan.exact_quantiles(long, ["column"], "value", {"median": 0.5})
    row = med.groupBy().pivot("column", list(columns)).agg(F.first("median"))
    row = row.select(*[F.col(c).alias(f"_med_{c}") for c in columns])
    out = out.join(F.broadcast(row), F.lit(True))
    return out.select(*[F.coalesce(F.col(c), F.col(f"_med_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def level_order(df: DataFrame, column: str, levels: Sequence[str], out: str = "level") -> DataFrame:
    """Position of a value in a fixed level list (the first is the reference); null when unlisted."""
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(column))
    return df.withColumn(out, F.when(place > 0, place - 1))


def invalid_letters(seq: Column, alphabet: str) -> Column:
    """Distinct letters of a text outside the alphabet, sorted and joined."""
    letters = F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.upper(seq), f"[{alphabet}]", ""), F.lit("(?s)."), F.lit(0)))
    return F.array_join(F.array_sort(letters), "")


def species_directory(name: Column) -> Column:
    """Directory name of a species; unknown names pass through in lower case."""
    key = F.lower(F.trim(name))
    table = F.create_map(*[F.lit(x) for kv in SPECIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.replace(key, F.lit(" "), F.lit("_")))


def zero_grid(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Long table with every row and column key, absent cells as zero.

    The grid is the result itself; it is built from the two key lists.
    """
    rows, cols = df.select(row).distinct(), df.select(column).distinct()
    grid = rows.join(cols, F.lit(True))
    return grid.join(df, [row, column], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def consecutive_gap(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distance to the next row of the same key, by a blocked running minimum."""
    rows = df.select(key, order).distinct().withColumn("_block", scan.width_block(order, 1 << 16))
    seen = scan.running(rows, [key], [order], "_block", [("_next", order, "min", "after")])
    return seen.select(key, order, (F.col("_next") - F.col(order)).alias("gap"))


def best_rows(df: DataFrame, key: str, by: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("rank") <= n)

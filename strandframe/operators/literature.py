"""Literature records: search, screening, duplicates, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boolean_search(
    docs: DataFrame, every: Sequence[str] = (), some: Sequence[str] = (), none: Sequence[str] = (), phrases: Sequence[str] = (),
    fields: Sequence[str] = ("title", "abstract"), years: tuple[int, int] | None = None, kinds: Sequence[str] = (),
) -> DataFrame:
    """AND words, OR words, NOT words and phrases over the named text fields.

    Words match whole and without case; ``years`` needs a ``year`` column and
    ``kinds`` a ``kind`` column.
    """
    text = F.lower(F.concat_ws(" ", *fields))
    word = lambda w: text.rlike(rf"(?<![\p{{L}}\p{{N}}])\Q{w.lower()}\E(?![\p{{L}}\p{{N}}])")
    keep: Column = F.lit(True)
    for w in every:
        keep = keep & word(w)
    if some:
        either: Column = F.lit(False)
        for w in some:
            either = either | word(w)
        keep = keep & either
    for w in none:
        keep = keep & ~word(w)
    for p in phrases:
        keep = keep & text.contains(p.lower())
    if years:
        keep = keep & F.col("year").between(*years)
    if kinds:
        keep = keep & F.col("kind").isin(*kinds)
    return docs.where(keep)


def literature_records(raw: DataFrame, max_authors: int = 10) -> DataFrame:
    """Record fields with at most ten authors and the DOI from the id map."""
    return raw.select("pmid", "title", "journal", "date", F.slice("authors", 1, max_authors).alias("authors"), F.coalesce(F.element_at("ids", "doi"), F.lit("")).alias("doi"))


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def dedupe_records(records: DataFrame) -> DataFrame:
    """First record (lowest pmid) per DOI, or per normalised title without one."""
    key = F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit("doi:"), F.lower("doi"))).otherwise(F.concat(F.lit("title:"), normal_title(F.col("title"))))
    # only the winners are found by key, so copies are reduced before any shuffle
    first = records.groupBy(key.alias("_k")).agg(F.min("pmid").alias("pmid")).select("pmid")
    return records.join(first, "pmid", "left_semi")


def screening_funnel(records: DataFrame, screened: Column, included: Column) -> DataFrame:
    """Counts from identified over deduplicated and screened to included."""
    single = dedupe_records(records).select("pmid").withColumn("_d", F.lit(1))
    staged = records.select("pmid", screened.alias("_s"), included.alias("_i")).join(single, "pmid", "left")
    one = F.coalesce("_d", F.lit(0))
    ok = (one == 1) & F.col("_s")
    return staged.agg(
        F.count(F.lit(1)).alias("identified"), F.sum(one).alias("deduplicated"), F.sum(ok.cast("long")).alias("screened"), F.sum((ok & F.col("_i")).cast("long")).alias("included")
    )


def rank_by_citations(records: DataFrame, citations: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most cited records; ``citations`` holds (pmid, cited_by)."""
    counts = citations.groupBy("pmid").agg(F.count(F.lit(1)).alias("cited"))
    return records.join(counts, "pmid").orderBy(F.desc("cited"), "pmid").limit(n)


def format_citation(records: DataFrame, style: str = "vancouver") -> DataFrame:
    """Citation text from authors ('Family Given'), title, journal, year, volume, pages, doi."""
    family = lambda a: F.split_part(a, F.lit(" "), F.lit(1))
    initial = lambda a: F.left(F.split_part(a, F.lit(" "), F.lit(2)), F.lit(1))
    short = F.transform("authors", lambda a: F.concat(family(a), F.lit(" "), initial(a)))
    dotted = F.transform("authors", lambda a: F.concat(family(a), F.lit(", "), initial(a), F.lit(".")))

    def joined(names: Column, last: str) -> Column:
        n = F.size(names)
        return F.when(n > 1, F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(last), F.element_at(names, -1))).otherwise(F.array_join(names, ", "))

    if style == "vancouver":
        text = F.format_string("%s. %s. %s. %d;%s:%s. doi:%s", F.array_join(short, ", "), "title", "journal", "year", "volume", "pages", "doi")
    elif style == "nature":
        text = F.format_string("%s %s. %s %s, %s (%d).", joined(dotted, " & "), "title", "journal", "volume", "pages", "year")
    elif style == "apa":
        text = F.format_string("%s (%d). %s. %s, %s, %s. https://doi.org/%s", joined(dotted, ", & "), "year", "title", "journal", "volume", "pages", "doi")
    else:
        raise ValueError("style must be vancouver, nature or apa")
    return records.select("pmid", text.alias("citation"))


def id_batches(ids: DataFrame, key: str, size: int = 50) -> DataFrame:
    """Batches of ``size`` ids in order, each with its joined id list."""
    from strandframe.plans.scan import row_positions

    placed = row_positions(ids.select(key), [F.asc(key)])
    batch = F.floor((F.col("position") - 1) / size)
    return placed.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(key)), ",").alias("ids"))

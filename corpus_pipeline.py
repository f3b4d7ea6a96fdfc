"""Training-corpus pipeline: language, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  ``run`` writes each stage's rows to the shared folder as Parquet
and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import decontaminate, language, mixing, near_dedup, sharding
from strandframe.llm.common import stored, table
from strandframe.llm.queries import MIX

#: A text none of whose languages reaches this share has no main language.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters or without a main language go; a missing ``lang`` is filled in.

    Null and empty texts go; rows of repeated or null ids are judged one by one.
    """
    found = language.identify(docs).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SHARE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest doc_id (five-word shingles, similarity 0.8 or more).

    Null ids come last, of equal ids the smaller text hash stays; texts without words all stay.
    """
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten benchmark words go, each by its own text; null texts stay."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens by the weights of the mix, every document at most once."""
    return mixing.mixed(docs, MIX, fraction=0.9, epochs=1).select(*docs.columns)


def bin_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("sharding", bin_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

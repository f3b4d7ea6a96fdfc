"""Interaction audit of document filters in every order, by wide packed counters.

A document is a mask of the filters that it fails.  What a mask does at step s of
one order (kept, removed, redundant, failing alone, good lost, toxic lost) is fixed,
so a mask is mapped to one big integer: a field of 64 bits for each outcome at each
step of each order (5 filters: 600 steps, 3,600 fields).  Adding the integers of a
part's documents adds all fields at once; a field holds at most the number of
documents, below 2**63, so no field carries into the next.

Equal masks of a part are counted before their integers are made: count times
integer is the sum of that many, so what is shuffled is bounded by parts x masks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.common import stored

OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BYTES = 8
BLANKS = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone: few words, few distinct words, many capitals, odd signs."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n, points = F.size(words), F.char_length(text)
    capitals = points - F.char_length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals > 3 * points,
        "D": text.rlike("[#$%&*|]"),
    }


@cache
def orders(letters: str) -> tuple[str, ...]:
    return tuple("".join(p) for p in permutations(letters))


@cache
def packed(letters: str, mask: int, good: bool, toxic: bool) -> int:
    """The integer of a mask: bit i of ``mask`` is a failure of filter ``letters[i]``."""
    fails = {c for i, c in enumerate(letters) if mask >> i & 1}
    fields = []
    for order in orders(letters):
        gone = False
        for letter in order:
            failing = letter in fails
            removed = failing and not gone
            redundant = failing and gone
            gone = gone or failing
            fields.append((not gone, removed, redundant, fails == {letter}, removed and good, removed and toxic))
    return int.from_bytes(np.array(fields, "<u8").tobytes(), "little")


def unpacked(total: int, letters: str) -> pd.DataFrame:
    """filter_order, step, the outcomes and shapley: one row per step of every order."""
    steps = [(order, k + 1, letter) for order in orders(letters) for k, letter in enumerate(order)]
    fields = np.frombuffer(total.to_bytes(len(steps) * len(OUTCOMES) * FIELD_BYTES, "little"), "<u8").astype(np.int64)
    out = pd.DataFrame(steps, columns=["filter_order", "step", "letter"])
    out[list(OUTCOMES)] = fields.reshape(-1, len(OUTCOMES))
    out["shapley"] = out.groupby("letter")["removed"].transform("sum")
    return out.drop(columns="letter")


def _copies(told: DataFrame, parts: Sequence[str]) -> DataFrame:
    """``parts``, ``again`` (its text is that of a smaller doc_id), ``n``: rows of ``told`` counted.

    A text that holds a third of all rows is counted per part before its groups
    meet, so no row is joined to its copies.  Equal doc_ids with equal texts are
    none smaller than the other; a row without doc_id is later than all that have one.
    """
    same_row = told.groupBy("doc_id", "digest", *parts).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    side = same_row.groupBy("digest", *parts).agg(
        first.alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    # rows of the smallest doc_id; all rows where no copy has one
    fresh = F.when(least.isNull(), F.col("no_id")).when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    split = side.withColumn("fresh", fresh).select(
        *parts, F.explode(F.array(F.struct(F.lit(False).alias("again"), F.col("fresh").alias("n")), F.struct(F.lit(True).alias("again"), (F.col("n") - F.col("fresh")).alias("n")))).alias("s")
    )
    return split.select(*parts, "s.again", "s.n").where("n > 0")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n of ``docs`` (doc_id, text, lang) under the five filters A to E."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(failing, F.lit(1 << i)).otherwise(0) for i, failing in enumerate(text_failures(text).values())), F.lit(0))
    told = stored(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), bits.alias("bits")), "masks")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    # rows without doc_id have no label: they stay out of the join, where they would be one key
    met = told.where("doc_id is not null").join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    rest = told.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    parts = _copies(met.unionByName(rest), ["part", "bits", "good", "toxic"])
    mask = F.col("bits") + F.when(F.col("again"), F.lit(16)).otherwise(0)
    return parts.groupBy("part", mask.alias("mask"), "good", "toxic").agg(F.sum("n").alias("n"))


def interactions(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, the outcomes and shapley from ``counts`` (part, mask, good, toxic, n).

    Each task adds the integers of its rows per part, then the integers of a part
    meet; a part has at most 4 * 2**len(letters) rows of ``counts``.
    """
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[str, int] = {}
            for part, mask, good, toxic, n in batch[["part", "mask", "good", "toxic", "n"]].itertuples(index=False):
                sums[part] = sums.get(part, 0) + int(n) * packed(letters, int(mask), bool(good), bool(toxic))
                if len(sums) == 256:
                    yield wide(sums)
                    sums = {}
            yield wide(sums)

    def wide(sums: dict[str, int]) -> pd.DataFrame:
        return pd.DataFrame({"part": list(sums), "packed": [v.to_bytes((v.bit_length() + 7) // 8, "little") for v in sums.values()]})

    def unpack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(int.from_bytes(v, "little") for v in frame["packed"])
        return unpacked(total, letters).assign(part=key[0])

    kinds = ", ".join(f"{c} long" for c in (*OUTCOMES, "shapley"))
    partial = counts.mapInPandas(summed, "part string, packed binary")
    return partial.groupBy("part").applyInPandas(unpack, f"part string, filter_order string, step int, {kinds}")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang, null: empty string), order of the filters A to E and step.

    ``docs`` has doc_id, text, lang; ``labels`` has doc_id, quality, toxic (of
    repeated ids the largest mark counts); other columns are ignored.  Null texts are
    empty: they fail A, pass B, C and D, and are copies of each other and of empty
    texts.  Rows of one doc_id with one text are not copies of a smaller id; a null
    doc_id has no label and is later than every other.  No documents: no rows.
    """
    return interactions(mask_counts(docs, labels))

"""Exact dedup by a tree-merge of sorted digest runs.

Every partition of the stored digests makes a sorted run: one record per digest
with the row that stays and the number of rows.  Runs are cut by the leading bits
of the digest into buckets of bounded size, and a run's piece of a bucket travels as
one packed row.  In every round ``fan`` neighbouring runs of a bucket are merged
into one, as in a binomial tree with ``fan`` children, until one run per bucket is
left.  Records merge only if the whole SHA-256 and the normalised length agree, and
the best row is retained, so each level holds the verified choice of its subtree.

A text that holds a third of all rows is one record per run.  The answers return by
(digest, run), so the rows of such a text stay spread over their partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import stored

#: A run's record: digest words, bytes of the normalised text; the row that stays; rows merged.
RECORD = np.dtype([("digest", ">u8", 4), ("size", "<i8"), ("points", "<i8"), ("no_id", "?"), ("doc_id", "<i8"), ("row", "<i8"), ("rows", "<i8")])
#: Rows that a task holds before it sorts them into runs, and rows of all runs due in a bucket.
HELD, BUCKET = 1 << 18, 1 << 16
PACKED = "bucket long, run long, packed binary"


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of sorted runs: a stable merge by the first digest word, then equal digests become one record."""
    cat = np.concatenate(runs, dtype=RECORD)  # which by itself would turn the digests to the machine's byte order
    words = cat["digest"].astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    tied = words[order[1:], 0] == words[order[:-1], 0]
    shared = np.flatnonzero(np.append(tied, False) | np.insert(tied, 0, False))
    if len(shared):  # records of one first word: by the whole digest, the row that stays first
        some = cat[order[shared]]
        keys = [some[c] for c in ("row", "doc_id", "no_id")] + [-some["points"], some["size"]] + [words[order[shared], k] for k in (3, 2, 1, 0)]
        order[shared] = order[shared][np.lexsort(keys)]
    new = np.ones(len(cat), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1) | (cat["size"][order[1:]] != cat["size"][order[:-1]])
    starts = np.flatnonzero(new)
    out = cat[order[starts]]
    if len(out):
        out["rows"] = np.add.reduceat(cat["rows"][order], starts)
    return out


def _pieces(run: int, records: np.ndarray, bits: int) -> pd.DataFrame:
    """A sorted run cut into its buckets."""
    bucket = (records["digest"][:, 0].astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(records), np.int64)
    at, first = np.unique(bucket, return_index=True)
    return pd.DataFrame({"bucket": at, "run": run, "packed": [x.tobytes() for x in np.split(records, first[1:])]})


def sorted_runs(prints: DataFrame, bits: int) -> DataFrame:
    """Packed pieces of sorted runs of ``prints`` (run, digest, size, points, doc_id, row)."""
    def cut(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run, rows in pd.concat(held).groupby("run"):
            records = np.zeros(len(rows), RECORD)
            records["digest"] = np.frombuffer(b"".join(rows["digest"]), ">u8").reshape(-1, 4)
            for c in ("size", "points", "no_id", "doc_id", "row"):
                records[c] = rows[c]
            records["rows"] = 1
            yield _pieces(run, merge([records]), bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= HELD:
                yield from cut(held)
                held, n = [], 0
        if n:
            yield from cut(held)

    # no null longs in a batch, which pandas would read as floats
    whole = prints.withColumns({"no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    return whole.mapInPandas(run, PACKED)


def tree_merged(runs: DataFrame, n_runs: int, fan: int) -> DataFrame:
    """One run per bucket, after rounds in which ``fan`` neighbouring runs become one."""
    def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        one = merge([np.frombuffer(x, RECORD) for x in frame["packed"]])
        return pd.DataFrame({"bucket": [key[0]], "run": [key[1]], "packed": [one.tobytes()]})

    while True:
        runs = stored(runs.groupBy("bucket", F.expr(f"run div {fan}").alias("run")).applyInPandas(join, PACKED), "runs")
        n_runs = -(-n_runs // fan)
        if n_runs <= 1:
            return runs


def records(runs: DataFrame) -> DataFrame:
    """digest, keep_id, keep_row, group_size of every record of ``runs`` with two rows or more."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["packed"]:
                r = np.frombuffer(blob, RECORD)
                r = r[r["rows"] > 1]
                ids = pd.Series(r["doc_id"].astype(np.int64), dtype="Int64").mask(r["no_id"])
                yield pd.DataFrame({"digest": [d.tobytes() for d in r["digest"]], "keep_id": ids, "keep_row": r["row"].astype(np.int64), "group_size": r["rows"].astype(np.int64)})

    return runs.select("packed").mapInPandas(read, "digest binary, keep_id long, keep_row long, group_size long")


def exact_copies(docs: DataFrame, fan: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts are equal when they are identical without the characters
    ``[\\x20\\x09-\\x0D]``; null counts as empty.  Of equal texts the row with the most
    code points stays, then the smallest doc_id (null last), then the first row as
    stored, so exactly one row of a group is kept even where doc_ids repeat.
    ``keep_id`` is null if that row has no doc_id.  An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")
    prints = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(bare, 256)).alias("digest"), F.octet_length(bare).cast("long").alias("size"),
        F.char_length(text).cast("long").alias("points"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().cast("long").alias("run"),
    )
    prints = stored(prints, "digests")
    n, last = prints.agg(F.count(F.lit(1)), F.max("run")).first()
    bits = max(0, (max(n, 1) - 1) // BUCKET).bit_length()
    merged = tree_merged(stored(sorted_runs(prints, bits), "runs"), (last or 0) + 1, fan)
    homes = prints.select("digest", "run").distinct()
    answers = homes.join(records(merged), "digest")
    out = prints.select("doc_id", "digest", "row", "run").join(answers, ["digest", "run"], "left")
    alone = F.col("keep_row").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )

"""Quality selection by importance resampling over hashed word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import slices, stored
from strandframe.llm.words import WordHash, grams, split_words
from strandframe.plans.scan import row_positions

CELLS = 1 << 20
#: Pseudo texts that draw a gram's toxic share to the base rate.
PRIOR_TEXTS = 10.0
#: Pseudo n-grams that draw a cell's log ratio to zero.
PRIOR_GRAMS = 1.0
FLUSH = 1 << 20
#: Cells of one block; a task sends its counts as CELLS / BLOCK compressed blocks, however many texts it read.
BLOCK = 1 << 12
#: Labels of at most so many bytes (ROW_BYTES each) are sent to every executor; more are joined by shuffle.
LABEL_BYTES, ROW_BYTES = 32 << 20, 64
#: Grams that the model of toxic text holds at most, those of most toxic texts first.
TOXIC_GRAMS = 1 << 20
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def _cells(text: str | None, cache: WordHash) -> np.ndarray:
    h = cache.of(split_words(text, lower=True))
    return (np.concatenate([grams(h, 1), grams(h, 2, 1)]) & np.uint64(CELLS - 1)).astype(np.int64)


def _marks(text: str | None, cache: WordHash) -> np.ndarray:
    """Distinct 64-bit unigrams and bigrams of a text without its ASCII punctuation."""
    h = cache.of((text or "").encode("utf-8", "surrogatepass").translate(PLAIN).lower().split())
    return np.unique(np.concatenate([grams(h, 1), grams(h, 2, 1)])).view(np.int64)


def _met(known: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Places in the sorted ``known`` of the ``marks`` that are there."""
    if not len(known):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(known, marks), len(known) - 1)
    return at[known[at] == marks]


def evidence(bad: np.ndarray, fine: np.ndarray, n_bad: int, n_fine: int) -> np.ndarray:
    """Likelihood-ratio statistic of grams held by ``bad`` toxic and ``fine`` clean texts; 0 where toxic texts hold it less often."""
    held, rate = bad + fine, n_bad / (n_bad + n_fine)
    total = np.zeros(len(bad))
    for seen, due in ((bad, held * rate), (fine, held * (1 - rate)), (n_bad - bad, (n_bad + n_fine - held) * rate), (n_fine - fine, (n_bad + n_fine - held) * (1 - rate))):
        total += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(due, 1e-300)), 0.0)
    return np.where(bad > held * rate, total, 0.0)


def _enough(n_bad: int, n_fine: int, needed: float) -> int:
    """Least number of toxic texts that make a gram telling if no clean text holds it (evidence grows with the number)."""
    lo, hi = 1, n_bad + 1
    while lo < hi:
        mid = (lo + hi) // 2
        if evidence(np.array([mid]), np.array([0]), n_bad, n_fine)[0] > needed:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _suspects(toxic: DataFrame, n_bad: int, n_fine: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted grams of labelled ``toxic`` texts that can still be telling, the number of such texts, the evidence needed.

    A gram held by so few toxic texts that it would not be telling even if no clean text held it stays in Spark.
    """
    if not n_bad or not n_fine:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            cache = WordHash()
            gram, bad = np.unique(np.concatenate([_marks(t, cache) for t in part.column("text").to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(bad)], ["gram", "bad"])

    seen = stored(toxic.select("text").mapInArrow(count, "gram long, bad long").groupBy("gram").agg(F.sum("bad").alias("bad")), "toxic_grams")
    needed = 2 * np.log(max(seen.count(), 2))
    found = seen.where(F.col("bad") >= _enough(n_bad, n_fine, needed)).orderBy(F.desc("bad"), "gram").limit(TOXIC_GRAMS).toArrow()
    gram, bad = found["gram"].to_numpy(), found["bad"].to_numpy()
    order = np.argsort(gram)
    return gram[order], bad[order], needed


PACKED = "at long, counts binary"


def _packed(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts (kinds x places) of a task as compressed blocks of BLOCK places; blocks of zeros are left out."""
    for at in range(0, sums.shape[1], BLOCK):
        block = np.zeros((len(sums), BLOCK), np.int64)
        part = sums[:, at : at + BLOCK]
        if part.any():
            block[:, : part.shape[1]] = part
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([pa.compress(block.tobytes(), "zstd", asbytes=True)], pa.binary())], ["at", "counts"])


def _added(blocks: DataFrame, kinds: int, places: int) -> np.ndarray:
    """Sum of all tasks' blocks.  A group holds one row per task; the driver gets kinds x places sums."""
    size = 8 * kinds * BLOCK

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(kinds * BLOCK, np.int64)
        for packed in frame["counts"]:
            total += np.frombuffer(pa.decompress(packed, size, "zstd", asbytes=True), np.int64)
        return pd.DataFrame({"at": [key[0]], "counts": [total.tobytes()]})

    out = np.zeros((kinds, -(-places // BLOCK) * BLOCK), np.int64)
    for r in blocks.groupBy("at").applyInPandas(add, PACKED).toLocalIterator():
        out[:, r["at"] : r["at"] + BLOCK] = np.frombuffer(r["counts"], np.int64).reshape(kinds, BLOCK)
    return out[:, :places]


def cell_counts(texts: DataFrame, target: Column) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all n-grams per cell, over all texts and over those where ``target`` holds."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, CELLS), np.int64)
        waiting: list[list[np.ndarray]] = [[], []]
        held = 0

        def flush() -> None:
            for k in range(2):
                if waiting[k]:
                    sums[k] += np.bincount(np.concatenate(waiting[k]), minlength=CELLS)
                    waiting[k].clear()

        for part in slices(batches, "text"):
            cache = WordHash()
            for text, wanted in zip(part.column("text").to_pylist(), part.column("target").to_pylist(), strict=True):
                c = _cells(text, cache)
                waiting[0].append(c)
                if wanted:
                    waiting[1].append(c)
                held += len(c)
                if held > FLUSH:
                    flush()
                    held = 0
        flush()
        yield from _packed(sums)

    raw, wanted = _added(texts.select("text", target.alias("target")).mapInArrow(count, PACKED), 2, CELLS)
    return raw, wanted


def _held(texts: DataFrame, grams: np.ndarray) -> np.ndarray:
    """Number of ``texts`` that hold each of the ``grams``."""
    shared = texts.sparkSession.sparkContext.broadcast(grams)  # at most TOXIC_GRAMS longs

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((1, len(shared.value)), np.int64)
        for part in slices(batches, "text"):
            cache = WordHash()
            for text in part.column("text").to_pylist():
                sums[0, _met(shared.value, _marks(text, cache))] += 1
        yield from _packed(sums)

    out = _added(texts.select("text").mapInArrow(count, PACKED), 1, len(grams))[0]
    shared.unpersist()
    return out


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, target, clean, toxic of every row; ids without a label are none of these."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_q"), F.max("toxic").alias("_t"))
    small = labels.count() * ROW_BYTES <= LABEL_BYTES
    base = docs.select("doc_id", "text").join(F.broadcast(marks) if small else marks, "doc_id", "left")
    no = F.lit(False)
    base = base.select(
        "doc_id", "text", ((F.coalesce(F.col("_q") == 1, no)) & (F.coalesce("_t", F.lit(0)) == 0)).alias("target"),
        F.coalesce(F.col("_t") == 0, no).alias("clean"), F.coalesce(F.col("_t") == 1, no).alias("toxic"),
    )
    return base if small else stored(base, "labelled")  # after a shuffle, texts are not shuffled again


def resampled(docs: DataFrame, labels: DataFrame, keep: float = 0.5, seed: int = 23) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept for every row of ``docs`` (doc_id, text).

    Target model: texts that ``labels`` (doc_id, quality, toxic) calls good and not
    toxic.  Raw model: all texts.  Both count hashed unigrams and bigrams over all
    their rows; a cell's log ratio is that of its count to the count due in the
    target, both with pseudo n-grams.  ``log_weight`` is the mean log ratio per n-gram times the square
    root of their number, so long texts do not outweigh the rest; adding seeded
    Gumbel noise and keeping the ``keep`` share with the largest keys samples
    without replacement in proportion to the weights.

    Toxic model: unigrams and bigrams (64-bit, no shared cells) that labelled toxic
    texts hold more often than labelled clean ones beyond chance, each with the log
    ratio of its shrunken odds to the base odds.  A text whose base odds and ratios
    sum above zero is never kept, labelled or not, nor is a text labelled toxic.
    Without both kinds of label only the labels reject.  If more rows are rejected
    than ``keep`` leaves out, fewer than the ``keep`` share stay.

    Texts without words weigh 0.  The noise is a hash of doc_id and text, so rows of
    one null or repeated id draw alone.  Ties keep the smaller doc_id, then the
    smaller text hash.  Without any target text every weight is 0; an empty table
    gives no rows.
    """
    base = _labelled(docs, labels)
    n, n_bad, n_fine = base.agg(F.count(F.lit(1)), F.count_if("toxic"), F.count_if("clean")).first()
    gram, bad, needed = _suspects(base.where("toxic"), n_bad, n_fine)
    fine = _held(base.where("clean"), gram) if len(gram) else np.zeros(0, np.int64)
    raw, target = cell_counts(base, F.col("target"))
    ratio = np.zeros(CELLS)
    if target.sum():
        ratio = np.log((target + PRIOR_GRAMS) / (target.sum() * (raw / raw.sum()) + PRIOR_GRAMS))

    telling = evidence(bad, fine, n_bad, n_fine) > needed if len(gram) else np.zeros(0, bool)
    rate = n_bad / max(n_bad + n_fine, 1)
    share = (bad[telling] + PRIOR_TEXTS * rate) / (bad[telling] + fine[telling] + PRIOR_TEXTS)
    prior = np.log(rate / (1 - rate)) if 0 < rate < 1 else -np.inf
    shared = base.sparkSession.sparkContext.broadcast((ratio, gram[telling], np.log(share / (1 - share)) - prior, prior))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, known, gain, prior = shared.value
        for part in slices(batches, "text"):
            cache, weights, out = WordHash(), [], []
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                c = _cells(text, cache)
                weights.append(float(ratio[c].mean() * np.sqrt(len(c))) if len(c) else 0.0)
                out.append(bool(toxic or prior + gain[_met(known, _marks(text, cache))].sum() > 0))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(weights, pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "text_key", "log_weight", "_out"])

    rows = base.select("doc_id", F.xxhash64("text").alias("text_key"), "text", "toxic")
    judged = stored(rows.mapInArrow(judge, "doc_id long, text_key long, log_weight double, _out boolean"), "judged")
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_key"), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = judged.withColumn("gumbel_key", F.when(F.col("_out"), F.lit(float("-inf"))).otherwise(F.col("log_weight") - F.log(-F.log(unit))))
    ranked = row_positions(keyed, [F.col("gumbel_key").desc(), F.col("doc_id").asc(), F.col("text_key").asc()])
    return ranked.select("doc_id", "log_weight", "gumbel_key", ((F.col("position") <= int(n * keep)) & ~F.col("_out")).alias("kept"))

"""Texts of an Arrow batch as one array of letters, so that a step runs over many rows at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.plans.storage import cut_lineage

#: Letters that a task works on at once, and letters of the longest text that is handled whole.
SLICE = 1 << 20


def slices(lengths: list[int] | np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` letters each; a longer row is a range of its own."""
    part = np.cumsum(lengths) // most
    at = 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]:
        if end > at:
            yield at, end
        at = end


def points(text: str) -> np.ndarray:
    """Code points of a text, one byte each where they fit."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def one_byte(text: str) -> np.ndarray:
    """One byte a letter; letters beyond ASCII become question marks."""
    return np.frombuffer(text.encode("ascii", "replace"), np.uint8)


class Rows:
    """Texts set one after another: all letters, and the row, first place and length of each."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """Rows that hold the letters ``at``."""
        return np.searchsorted(self.first + self.size, at, side="right")

    def each(self) -> np.ndarray:
        """Row of every letter."""
        return np.repeat(np.arange(len(self.size)), self.size)


def windows(rows: Rows, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``k`` letters of one row start, and a number for the letters there: equal windows have equal numbers."""
    letters = points(rows.text)
    if len(letters) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # letters by rank
    if letters.dtype == np.uint8:
        seen = np.bincount(letters, minlength=256) > 0
        rank, base = (np.cumsum(seen) - 1)[letters], int(seen.sum())
    else:
        known, rank = np.unique(letters, return_inverse=True)
        base = len(known)
    end = len(letters) - k + 1
    code, span = rank[:end].astype(np.int64), base
    for j in range(1, k):
        if span * base >= 1 << 40:
            known, code = np.unique(code, return_inverse=True)
            span = len(known)
        code = code * base + rank[j : end + j]
        span *= base
    last = np.repeat(rows.first + rows.size, rows.size)[:end]
    at = np.flatnonzero(np.arange(end) + k <= last)
    return at, code[at]


def mapped(df: DataFrame, work: Callable[[Rows], tuple[np.ndarray, dict]], key: str, text: str, schema: str) -> DataFrame:
    """``key`` and the columns that ``work`` finds for slices of the rows of ``df``, as it names a row number for each."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices([len(t) for t in texts]):
                row, found = work(Rows(texts[lo:hi]))
                if len(row):
                    columns = [keys.take(pa.array(row + lo, pa.int64())), *[v if isinstance(v, pa.Array) else pa.array(v) for v in found.values()]]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, *found])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"{key} {kind}, {schema}")


def alone(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` no other row has and whose text is handled whole, and the rest."""
    long = F.coalesce(F.length(text) > SLICE, F.lit(False))
    odd = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(long).alias("_long")).where("_n > 1 or _long")
    odd = cut_lineage(odd.select(F.col(key).alias("_odd")))
    if not odd.take(1):
        # the usual case: nothing is left for the other way, which is planned away
        return df, df.sparkSession.createDataFrame([], df.schema)
    same = F.col(key).eqNullSafe(F.col("_odd"))
    return df.join(odd, same, "left_anti"), df.join(odd, same, "left_semi")

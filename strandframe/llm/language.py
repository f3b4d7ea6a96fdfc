"""Language ID by mixture inference over character n-grams.

Learning counts hashed character trigrams per language over all training rows.
A text is a mixture of languages: expectation-maximisation estimates their
proportions from the n-gram likelihoods, and the set of languages grows while
a language raises the likelihood by more than a penalty of ``0.5 log n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.common import slices

CELLS = 1 << 14
FOUND = ("lang_pred", "lang_score", "lang_share")
#: Runs of anything but Unicode letters (category L); \w alone also holds numerals such as superscripts.
_SPLIT = re.compile(r"\P{L}+")


def gram_cells(text: str) -> np.ndarray:
    """Cells of all character trigrams; runs of anything but letters count as one space.  No letter, no cell."""
    letters = _SPLIT.sub(" ", text.lower()).strip()
    if not letters:
        return np.empty(0, np.int64)
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (codes[:-2] * np.uint64(0x9E3779B1) ^ codes[1:-1] * np.uint64(0x85EBCA77C2B2) ^ codes[2:] * np.uint64(0x27D4EB2F165667C5)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(50)).astype(np.int64)


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their smoothed log likelihoods (languages x CELLS) and counts of all trigrams from ``rows`` (text, lang).

    Every row counts.  What reaches the driver is languages x CELLS sums; the
    number of languages is a property of the label set.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(CELLS, np.int64)
                sums[lang] += np.bincount(gram_cells(text), minlength=CELLS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], ["lang", "cell", "n"])

    used = rows.select("lang", "text").where("lang is not null and text is not null")
    got = used.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique().tolist())
    counts = np.full((len(langs), CELLS), 0.5)
    place = {name: i for i, name in enumerate(langs)}
    counts[got["lang"].map(place).to_numpy(int), got["cell"].to_numpy(int)] += got["n"].to_numpy(float)
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)) if langs else counts, counts - 0.5


def proportions(cells: np.ndarray, logp: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Proportion of every language in a text with trigrams in ``cells``."""
    at, c = np.unique(cells, return_counts=True)
    lp = logp[:, at]
    single = lp @ c
    chosen, best, n = [int(single.argmax())], float(single.max()), float(c.sum())
    penalty, share = 0.5 * np.log(n + 1), np.ones(1)
    p = np.exp(lp - lp.max(axis=0))
    base = float(lp.max(axis=0) @ c)
    while len(chosen) < len(logp):
        mix = share @ p[chosen]
        # the likelihood is concave, so a language can add at most this much
        bound = p @ (c / mix) - n
        bound[chosen] = -np.inf
        trial = None
        for add in map(int, np.argsort(-bound)):
            # no language from here on can gain more than its bound
            if bound[add] <= max(penalty, trial[0] - best if trial else 0.0):
                break
            q = p[[*chosen, add]]
            w = np.append(share * 0.9, 0.1)
            for _ in range(rounds):
                m = w @ q
                w2 = w * (q @ (c / m)) / n
                done = np.abs(w2 - w).max() < 1e-4
                w = w2
                if done:
                    break
            reached = base + float(np.log(w @ q) @ c)
            if trial is None or reached > trial[0]:
                trial = (reached, add, w)
        if trial is None or trial[0] <= best + penalty:
            break
        best, share, chosen = trial[0], trial[2], [*chosen, trial[1]]
    out = np.zeros(len(logp))
    out[chosen] = share
    return out


def mixture(text: str | None, logp: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
    """Language shares of a text: those of all training trigrams if it has none of them; None without a letter."""
    cells = gram_cells(text or "")
    if not len(cells):
        return None
    if not counts[:, cells].any():
        return counts.sum(axis=1) / counts.sum()
    return proportions(cells, logp)


def identified(docs: DataFrame, langs: list[str], logp: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Columns of ``docs`` plus lang_pred, lang_score and lang_share (language -> proportion), from ``text`` alone.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text when nothing was learned.  Ties go to the first language by name.
    """
    model = docs.sparkSession.sparkContext.broadcast((logp, counts))  # languages x CELLS doubles each

    rest = [c for c in docs.columns if c not in FOUND]
    kept = docs.select(*rest)
    found = T.StructType([
        T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_share", T.MapType(T.StringType(), T.DoubleType())),
    ])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            pred, score, shares = [], [], []
            for text in part.column("text").to_pylist():
                share = mixture(text, *model.value) if langs else None
                k = None if share is None else int(share.argmax())
                pred.append("und" if k is None else langs[k])
                score.append(0.0 if k is None else float(min(1.0, share[k])))
                shares.append([] if k is None else [(langs[i], float(share[i])) for i in np.flatnonzero(share)])
            more = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *FOUND])

    return kept.mapInArrow(predict, T.StructType([*kept.schema.fields, *found.fields]))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row of ``docs`` (doc_id, text, lang)."""
    return identified(docs, *learn(docs.where(~held_out())))

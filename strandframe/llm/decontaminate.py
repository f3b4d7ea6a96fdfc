"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents inside one task, at most ``SHARD_WORDS``
indexed words (a longer document is a shard of its own).  Words outside the
benchmark's vocabulary can match nothing, so only stretches of known words as
long as the shortest phrase are indexed.  Phrases are found by backward search
over the ranks of a wavelet matrix, and their places by stepping back to
sampled suffix positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import slices

SHARD_WORDS = 400_000
STRIDE = 8
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def phrase_words(text: str | None) -> list[bytes]:
    """A-Z folded; maximal runs of letters a-z, digits and non-ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Ranks:
    """Wavelet matrix: how often a symbol occurs before a place, and the symbol at a place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros, s = [], [], symbols
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(s) - int(self.levels[-1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.bits = bits

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(at), at.copy()
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class Index:
    """FM-index of a word-id text; 0 separates, ends the text, and never compares equal to another 0."""

    def __init__(self, ids: np.ndarray, n_symbols: int):
        n = len(ids)
        gaps = ids == 0
        rank, width = ids.astype(np.int64) + int(gaps.sum()), 1
        rank[gaps] = np.arange(gaps.sum())
        while True:  # prefix doubling, until stretches between separators differ or end
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - width)] = rank[width:]
            order = np.lexsort((ahead, rank))
            step = np.concatenate([[0], ((np.diff(rank[order]) != 0) | (np.diff(ahead[order]) != 0)).cumsum()])
            rank = np.empty(n, np.int64)
            rank[order] = step
            if step[-1] == n - 1:
                break
            width *= 2
        self.order = order
        last = ids[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=n_symbols))]).astype(np.int64)
        self.ranks = Ranks(last.astype(np.int64), max(1, int(n_symbols - 1).bit_length()))
        self.marked = (order % STRIDE == 0) | (last == 0)
        self.places = np.where(self.marked, order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long phrases (one per line)."""
        end = phrases[:, -1]
        lo, hi = self.first[end].copy(), self.first[end + 1].copy()
        for k in range(phrases.shape[1] - 2, -1, -1):
            s = phrases[:, k]
            lo, hi = self.first[s] + self.ranks.rank(s, lo), self.first[s] + self.ranks.rank(s, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows: step back to a sampled place and count the steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.marked[rows])
        while len(open_):
            at = rows[open_]
            s = self.ranks.access(at)
            rows[open_] = self.first[s] + self.ranks.rank(s, at)
            steps[open_] += 1
            open_ = open_[~self.marked[rows[open_]]]
        return self.places[rows] + steps


class Phrases:
    """Distinct windows of a block of benchmark items, by length, with the items that hold them."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in phrase_words(text)]
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                held.setdefault(tuple(w[i : i + n]), set()).update([] if name is None else [name])
        self.by_length = {}
        for n in sorted({len(p) for p in held}):
            some = [p for p in held if len(p) == n]
            self.by_length[n] = (np.array(some, np.int64), [sorted(held[p]) for p in some])
        self.least = min(self.by_length, default=0)


def _hits(texts: list[list[bytes]], phrases: Phrases) -> Iterator[tuple[int, int, int, list[str]]]:
    """(document, word, length, items) of every occurrence; documents are indexed shard by shard."""
    shard, docs, places, held = [], [], [], 0

    def flush():
        ids, doc, place = np.concatenate(shard), np.concatenate(docs), np.concatenate(places)
        index = Index(ids, len(phrases.vocabulary) + 1)
        for n, (grid, names) in phrases.by_length.items():
            lo, hi = index.search(grid)
            some = np.flatnonzero(hi > lo)
            if len(some):
                width = (hi - lo)[some]
                which = np.repeat(some, width)
                rows = np.repeat(lo[some], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                at = index.locate(rows)
                for d, p, w in zip(doc[at].tolist(), place[at].tolist(), which.tolist(), strict=True):
                    yield d, p, n, names[w]

    get = phrases.vocabulary.get
    for d, words in enumerate(texts):
        if not words or not phrases.least:
            continue
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]])))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= phrases.least
        if not long.any():
            continue
        mark = np.zeros(len(ids) + 1, np.int32)
        np.add.at(mark, starts[long], 1)
        np.add.at(mark, ends[long], -1)
        inside = np.cumsum(mark) > 0
        take = np.flatnonzero(inside | np.concatenate([[False], inside[:-1]]))  # each stretch and one separator
        shard.append(np.where(inside, np.append(ids, 0), 0)[take])
        docs.append(np.full(len(take), d))
        places.append(take)
        held += len(take)
        if held >= SHARD_WORDS:
            yield from flush()
            shard, docs, places, held = [], [], [], 0
    if shard:
        yield from flush()


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """(item_id, text) of the benchmark in blocks of about ``block_bytes``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    n_blocks = max(1, -(-n_bytes // block_bytes))
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        yield [(r["item_id"], r["text"]) for r in block]


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """Rows of ``docs`` (text and any others) in which no window of the benchmark occurs.

    Each row goes by its own text, so repeated and null ids do not matter; null and
    wordless texts stay.  Empty tables give no rows or take none away.
    """
    for block in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most about block_bytes

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(shared.value, window)
            for part in slices(batches, "text"):
                hit = np.zeros(part.num_rows, bool)
                for d, *_ in _hits([phrase_words(t) for t in part.column("text").to_pylist()], phrases):
                    hit[d] = True
                yield part.filter(pa.array(~hit))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, spans (merged word ranges), items, n_items, items_sha256, contaminated per row of ``docs``.

    ``benchmark`` (item_id, text) is the query set; it is read in blocks of about
    ``block_bytes`` and every document meets every block.  Null and wordless texts
    have no words on either side.  A null item_id hits but is not listed; items
    that repeat an id count once.  Empty tables give no rows or no hits.
    """
    out = docs.select("doc_id", "text", F.array().cast("array<int>").alias("ends"), F.array().cast("array<string>").alias("items"))
    kind = "doc_id long, text string, ends array<int>, items array<string>"
    sc = docs.sparkSession.sparkContext
    for block in _blocks(benchmark, block_bytes):
        shared = sc.broadcast(block)  # at most about block_bytes

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            phrases = Phrases(shared.value, window)
            for batch in batches:
                ends = [list(x) for x in batch["ends"]]
                found = [set(x) for x in batch["items"]]
                for d, p, n, names in _hits([phrase_words(t) for t in batch["text"]], phrases):
                    ends[d] += (p, p + n)
                    found[d].update(names)
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": batch["text"], "ends": ends, "items": [sorted(x) for x in found]})

        out = out.mapInPandas(scan, kind)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, ends, items in zip(batch["doc_id"], batch["text"], batch["ends"], batch["items"], strict=True):
                e = sorted(zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True)) if len(ends) else []
                spans: list[list[int]] = []
                for lo, hi in e:
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                n_hit = sum(hi - lo for lo, hi in spans)
                names = list(items)
                digest = hashlib.sha256(",".join(names).encode()).hexdigest()
                rows.append((doc, len(phrase_words(text)), n_hit, spans, names, len(names), digest, n_hit > 0))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_hit", "spans", "items", "n_items", "items_sha256", "contaminated"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return out.mapInPandas(
        merge,
        "doc_id long, n_words long, n_hit long, spans array<array<int>>, items array<string>, n_items long, items_sha256 string, contaminated boolean",
    )

"""Substring dedup: repeated word windows found by prefix-split suffix groups.

Every word position starts a suffix.  Suffixes are split by prefixes of growing
length.  First by an anchor of about half a window: the smallest anchor of each
window is kept, about one position in ten, and a window that occurs twice has the
same anchor both times.  Neighbouring windows of one anchor form a stretch, and the
windows of a text are cut into its stretches without gap or overlap.  Stretches are
looked at only where their anchor repeats.  Equal stretches settle all their windows
with one record each.  Where stretches of one anchor differ, one of each kind is split
further, into whole windows.  A window with two or more starts is an internal node
at that depth of the suffix tree, so its suffixes are the starts of all repeats of
at least that length.  Nodes are 128-bit path hashes counted with map-side combine
rather than trees in memory: a window that holds a third of all rows is one node,
which no prefix can split.

Texts are stored once and never shuffled for the search.  Which prefixes repeat is
told to the tasks by a bitmap of fixed size; a prefix that only shares a bit is
searched in vain, none is missed.  Texts of equal words are one text from then on:
each of their windows also starts elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import scratch, slices, stored
from strandframe.llm.words import MIX_A, MIX_B, WordHash, WordIndex, grams, scramble, split_words

#: Bits of the bitmaps that are sent to all tasks.
BITS = 1 << 27
#: Spans of at most so many bytes (ROW_BYTES a row, 8 a span) are sent to the tasks; more are joined by shuffle.
SENT_BYTES, ROW_BYTES = 32 << 20, 64
LOW = (1 << 64) - 1
#: Stretches of a text shorter than a window.
NONE = np.empty(0, np.uint64), np.empty(0, np.int64)


def anchors_of(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the smallest ``k``-word prefix (leftmost of equals) of each window, in order, and how many windows share each."""
    g = grams(h, k)
    span = window - k + 1
    if len(g) < span:
        return NONE
    # 32 bits of the hash above, the place below, so that one minimum finds both and equal windows choose alike
    half = np.uint64(32)
    packed = (g >> half << half) | np.arange(len(g), dtype=np.uint64)
    least, width = packed, 1
    while width < span:  # minima of doubled widths, the last ones overlapping
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # never falls from one window to the next
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return g[at[first]], np.diff(first, append=len(at))


def bitmap(keys: DataFrame, key: Column) -> np.ndarray:
    """One byte for each of BITS places: whether the ``key`` (a long) of a row falls on it.  The driver gets BITS / 8 bytes."""
    place = F.pmod(key, F.lit(BITS)) + 1
    built = keys.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in built.toLocalIterator():
        m = np.frombuffer(r["m"], np.uint8)
        at = (r["b"] - 1) * len(m)
        out[at : at + len(m)] = m
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.int64) % BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def indexed(docs: DataFrame, window: int, k: int) -> DataFrame:
    """``docs`` (row, doc_id, text) with n_words, the digest of the words (hi, lo), the row scrambled (mark) and the stretches (keys, sizes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            cache, n, hi, lo, ends, keys, sizes = WordHash(), [], [], [], [0], [], []
            for text in part.column("text").to_pylist():
                w = split_words(text)
                digest = xxhash.xxh3_128_intdigest(b" ".join(w))
                key, size = anchors_of(cache.of(w), window, k) if len(w) >= window else NONE
                n.append(len(w))
                hi.append((digest >> 64) - (1 << 63))
                lo.append((digest & LOW) - (1 << 63))
                keys.append(key.view(np.int64))
                sizes.append(size.astype(np.int32))
                ends.append(ends[-1] + len(key))
            mark = scramble(part.column("row").to_numpy().view(np.uint64)).view(np.int64)
            lists = [pa.ListArray.from_arrays(np.array(ends, np.int32), pa.array(np.concatenate(x), t)).cast(pa.list_(t)) for x, t in ((keys, pa.int64()), (sizes, pa.int32()))]
            more = [pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(mark), *lists]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "n_words", "hi", "lo", "mark", "keys", "sizes"])

    return docs.mapInArrow(run, "row long, doc_id long, text string, n_words long, hi long, lo long, mark long, keys array<long>, sizes array<int>")


def _flat(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of the list column ``name`` of a batch and where the lists of its rows begin and end."""
    column = part.column(name)
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def anchor_keys(rows: DataFrame, firsts: np.ndarray) -> DataFrame:
    """key of every stretch, of one row of equal texts only."""
    shared = rows.sparkSession.sparkContext.broadcast(firsts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys, ends = _flat(part, "keys")
            keep = np.repeat(marked(shared.value, part.column("mark").to_numpy()), np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep])], ["key"])

    return rows.where(F.size("keys") > 0).select("mark", "keys").mapInArrow(run, "key long")


class Stretches:
    """Chosen stretches of the rows of a batch with the path hashes of their windows, flat.

    ``bits`` are the bitmaps of first rows (by mark), of repeated anchors (by key)
    and, if given, of places.  A stretch is chosen if it is marked in all of them.
    """

    def __init__(self, part: pa.RecordBatch, bits: tuple[np.ndarray, ...], window: int):
        keys, ends = _flat(part, "keys")
        sizes = _flat(part, "sizes")[0].astype(np.int64)
        owner = np.repeat(np.arange(part.num_rows), np.diff(ends))
        before = np.insert(np.cumsum(sizes), 0, 0)
        first = before[:-1] - before[ends[:-1]][owner]
        mark = part.column("mark").to_numpy()[owner]
        place = scramble(mark.view(np.uint64) * MIX_A + first.astype(np.uint64)).view(np.int64)
        hit = marked(bits[0], mark) & marked(bits[1], keys)
        if len(bits) > 2:
            hit &= marked(bits[2], place)
        at = np.flatnonzero(hit)
        self.keys, self.sizes, self.first, self.place = keys[at], sizes[at], first[at], place[at]
        self.row = part.column("row").to_numpy()[owner[at]]
        if not len(at):
            return
        # neighbours are hashed together; the words of all such pieces lie in one list
        new = np.append(True, (np.diff(at) > 1) | (np.diff(owner[at]) > 0))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        words, begins, index, texts, held = [], [], WordIndex(), part.column("text"), (-1, [])
        for i, start, stop in zip(owner[at][head].tolist(), self.first[head].tolist(), (self.first + self.sizes)[tail].tolist(), strict=True):
            if held[0] != i:
                held = (i, split_words(texts[i].as_py()))
            begins.append(len(words))
            words += held[1][start : stop + window - 1]
        piece = np.cumsum(new) - 1
        #: Place of the first window of each stretch in ``paths``.
        self.at = np.array(begins)[piece] + self.first - self.first[head][piece]
        ids = index.of(words)
        self.paths = [grams(index.hashes(seed)[ids], window, seed) for seed in (1, 2)]

    def __len__(self) -> int:
        return len(self.row)

    def whole(self) -> list[np.ndarray]:
        """row, first, size, part (bits of the anchor), place, ka, kb of every stretch: its first and last window cover all its words."""
        ends = [scramble(p[self.at] * MIX_A + p[self.at + self.sizes - 1] * MIX_B + self.sizes.astype(np.uint64)).view(np.int64) for p in self.paths]
        return [self.row, self.first.astype(np.int32), self.sizes.astype(np.int32), (self.keys >> 32).astype(np.int32), self.place, *ends]

    def windows(self) -> list[np.ndarray]:
        """row, at, ka, kb of every window."""
        inside = np.arange(self.sizes.sum()) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        at = np.repeat(self.at, self.sizes) + inside
        return [np.repeat(self.row, self.sizes), (np.repeat(self.first, self.sizes) + inside).astype(np.int32), *(p[at].view(np.int64) for p in self.paths)]


def stretches_of(rows: DataFrame, bits: tuple[np.ndarray, ...], window: int, split: bool) -> DataFrame:
    """The stretches that are marked in ``bits`` (see :class:`Stretches`): their windows if ``split``, else one record each."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # BITS / 8 bytes each
    names = ["row", "at", "ka", "kb"] if split else ["row", "first", "size", "part", "place", "ka", "kb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = Stretches(part, shared.value, window)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (found.windows() if split else found.whole())], names)

    schema = "row long, at int, ka long, kb long" if split else "row long, first int, size int, part int, place long, ka long, kb long"
    return rows.select("row", "text", "mark", "keys", "sizes").where(F.size("keys") > 0).mapInArrow(run, schema)


def _spans(runs: DataFrame, window: int) -> DataFrame:
    """row and the merged word ranges [first, end) of its windows, flat, from row, first and size of neighbouring ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for packed in batch.column("runs").to_pylist():
                x = np.sort(np.array(packed, np.int64))
                first, end = x >> 32, (x >> 32) + (x & 0xFFFFFFFF) + window - 1
                reach = np.maximum.accumulate(end)
                cut = np.flatnonzero(first[1:] > reach[:-1])
                lists.append(np.stack([first[np.append(0, cut + 1)], reach[np.append(cut, len(x) - 1)]], 1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lists, pa.list_(pa.int64()))], ["row", "spans"])

    packed = F.shiftleft(F.col("first").cast("long"), 32) + F.col("size")
    per = runs.groupBy("row").agg(F.collect_list(packed).alias("runs"))  # places of one text
    return per.mapInArrow(run, "row long, spans array<long>")


def _touched(rows: DataFrame, window: int) -> DataFrame:
    """row and spans (merged word ranges of repeated windows) of every row of ``rows`` (see :func:`indexed`) that has any."""
    long = rows.where(f"n_words >= {window}")
    classes = stored(long.groupBy("hi", "lo").agg(F.min("mark").alias("mark"), F.count(F.lit(1)).alias("copies")), "classes")
    firsts = bitmap(classes, F.col("mark"))
    twice = anchor_keys(rows, firsts).groupBy("key").count().where("count > 1")
    bits = (firsts, bitmap(twice, F.col("key")))
    runs = stored(stretches_of(rows, bits, window, split=False), "stretches")
    kinds = stored(runs.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("copies"), F.min("part").alias("part"), F.min("place").alias("place")), "kinds")
    settled = runs.join(kinds.where("copies > 1").select("ka", "kb"), ["ka", "kb"], "left_semi")
    # one stretch of each kind of an anchor that has several; the only one of its kind is among them
    mixed = kinds.groupBy("part").count().where("count > 1").select("part")
    several = kinds.join(mixed, "part", "left_semi")
    nodes = stored(stretches_of(rows, (*bits, bitmap(several, F.col("place"))), window, split=True), "windows")
    deep = nodes.groupBy("ka", "kb").count().where("count > 1").select("ka", "kb")
    starts = nodes.join(deep, ["ka", "kb"], "left_semi")
    inner = _spans(settled.select("row", "first", "size").unionByName(starts.select("row", F.col("at").alias("first"), F.lit(1).alias("size"))), window)
    # all rows of a text that has copies lose all words
    copies = classes.where("copies > 1").select("hi", "lo")
    whole = long.select("row", "hi", "lo", "n_words").join(copies, ["hi", "lo"], "left_semi")
    whole = whole.select("row", F.array(F.lit(0).cast("long"), F.col("n_words")).alias("spans"))
    return inner.join(whole.select("row"), "row", "left_anti").unionByName(whole)


def repeated_words(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept_text, kept_sha256 for every row of ``docs`` (doc_id, text).

    A word goes when a window that covers it also starts anywhere else; ``spans``
    are the word ranges removed.  Null, empty and blank texts have no words and the
    digest of the empty text.  Rows are told apart by a row key, so repeated and null
    doc_ids are safe.  Texts shorter than a window keep all words.  An empty table
    gives an empty result.
    """
    k = max(1, window // 2)
    rows = stored(indexed(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), window, k), "rows")
    with scratch(docs.sparkSession) as keep:
        touched = keep(_touched(rows, window), "spans")
    size = touched.agg(F.coalesce(F.sum(F.size("spans") * 8 + ROW_BYTES), F.lit(0))).first()[0]
    given = rows.select("row", "doc_id", "text").join(F.broadcast(touched) if size <= SENT_BYTES else touched, "row", "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, gone, kept, digests = [], [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                w = split_words(text)
                n.append(len(w))
                for first, end in reversed(list(zip((spans or [])[::2], (spans or [])[1::2], strict=True))):
                    del w[first:end]
                gone.append(n[-1] - len(w))
                left = b" ".join(w)
                kept.append(left.decode("utf-8", "surrogatepass"))
                digests.append(hashlib.sha256(left).hexdigest())
            spans = part.column("spans")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), spans, pa.array(kept, pa.string()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept_text", "kept_sha256"])

    return given.mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<long>, kept_text string, kept_sha256 string")

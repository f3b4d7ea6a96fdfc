"""MinHash near-duplicates with circulant signatures and exact verification.

Two permutations of a universe of ``2**20`` cells make every signature
coordinate: the first scatters shingles, the second is read at a circular
shift of k for coordinate k.  ``bands`` x ``rows`` coordinates are banded;
40 x 6 misses a pair of similarity 0.8 with probability 6e-6, 40 x 8 one of
0.85 with 3e-6.

Work is kept linear in hot groups: equal shingle sets are one class before
banding, and each band bucket first checks its members against its smallest class
only.  Members that are then still in different components are paired among each
other.  Before any text is read again, a pair must pass an exact bound: a set's
sketch is a bitmap of four bits a shingle, and two sets share at most the bits that
both have plus the shingles that met on a bit.  Links come only from full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.common import components, picked, scratch, slices, stored
from strandframe.llm.words import WordHash, scramble, shingle_set, split_words

UNIVERSE = 1 << 20
MASK = (1 << 64) - 1
LONGS = pa.list_(pa.int64())


def _tables(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    scatter, shifted = rng.permutation(UNIVERSE).astype(np.int32), rng.permutation(UNIVERSE).astype(np.int32)
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate([shifted, shifted[: n - 1]]), n)


def signature(shingles: np.ndarray, scatter: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Coordinate k is the least value of the second permutation, read k cells on, over the scattered shingles."""
    cells = np.unique(scatter[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)])
    parts = [shifts[cells[i : i + 512]].min(axis=0) for i in range(0, len(cells), 512)]
    return np.min(parts, axis=0)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bitmap of the set, a power of two of at least four bits a shingle, as longs."""
    size = 1 << max(6, (4 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[((shingles >> np.uint64(24)) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def may_link(a: str, b: str, n_a: str, n_b: str, percent: int) -> Column:
    """Whether sets with sketches ``a``, ``b`` and sizes ``n_a``, ``n_b`` can reach the similarity; never false for a link.

    Of sketches of different size the larger is folded in halves.
    """
    least = f"least(size({a}), size({b}))"
    fold = lambda s: f"if(size({s}) > {least}, zip_with(slice({s}, 1, {least}), slice({s}, {least} + 1, {least}), (p, q) -> p | q), {s})"
    held = lambda s: f"aggregate({s}, 0, (t, p) -> t + bit_count(p))"
    met = f"aggregate(zip_with({fold(a)}, {fold(b)}, (p, q) -> bit_count(p & q)), 0, (t, p) -> t + p)"
    most = f"({met} + least({n_a} - {held(fold(a))}, {n_b} - {held(fold(b))}))"
    return F.expr(f"100 * least({n_a}, {n_b}) >= {percent} * greatest({n_a}, {n_b}) and 100 * {most} >= {percent} * ({n_a} + {n_b} - {most})")


def signed(docs: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """``docs`` (row, text and others) with n_shingles, set_hi and set_lo (128-bit digest of the set), band keys and sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter, shifts = _tables(bands * rows, seed)
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for part in slices(batches, "text"):
            cache, sizes, hi, lo, keys, bits = WordHash(), [], [], [], [], []
            for text in part.column("text").to_pylist():
                s = shingle_set(split_words(text, lower=True), n, cache)
                sizes.append(len(s))
                if not len(s):
                    hi.append(None)
                    lo.append(None)
                    continue
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                hi.append((digest >> 64) - (1 << 63))
                lo.append((digest & MASK) - (1 << 63))
                sig = signature(s, scatter, shifts).astype(np.uint64).reshape(bands, rows)
                acc = salt.copy()
                for j in range(rows):
                    acc = scramble(acc + sig[:, j])
                keys.append(acc.view(np.int64))
                bits.append(sketch(s))
            full = np.array(sizes) > 0
            longs = np.zeros(len(sizes), np.int64)
            longs[full] = [len(x) for x in bits]
            more = [pa.array(sizes, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), _lists(full * bands, keys), _lists(longs, bits)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "n_shingles", "set_hi", "set_lo", "bands", "sketch"])

    kinds = [T.StructField(c, T.LongType()) for c in ("n_shingles", "set_hi", "set_lo")] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("bands", "sketch")]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *kinds]))


def _lists(lengths: np.ndarray, parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(parts) if parts else np.empty(0, np.int64)).cast(LONGS)


def verified(pairs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` whose full sets meet ``100 * common >= percent * union``; texts come from ``rows`` (row, text)."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("row")).distinct().union(pairs.select("b").distinct()).distinct()
    texts = stored(picked(rows.select("row", "text"), wanted), "texts")
    sides = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_a", "text_b"):
            cache, keep, last = WordHash(), [], (None, None)
            for ta, tb in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True):
                if last[0] != tb:
                    last = (tb, shingle_set(split_words(tb, lower=True), n, cache))
                sa, sb = shingle_set(split_words(ta, lower=True), n, cache), last[1]
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * common >= percent * (len(sa) + len(sb) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, seed: int = 17, key: str | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, stays for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null, empty and blank texts have no shingles and link with nothing.  Rows are
    told apart by a row key, so repeated and null doc_ids lose no link: every
    distinct shingle set is one class with one row and one text.  ``component_id``
    is the smallest doc_id of the rows linked (null if all are null); ``kept`` says
    that the row has that doc_id, so rows of one id agree.  ``stays`` is one row of a
    component: the smallest doc_id (null last), of equal ids the smallest text hash.
    ``key`` names a column of stored, unique longs to use as row key, which then
    comes back as well.  An empty table gives an empty result.
    """
    row = F.monotonically_increasing_id() if key is None else F.col(key)
    with scratch(docs.sparkSession) as keep:
        sign = stored(signed(_rows(docs, row), n, bands, rows, seed), "signatures")
        found = keep(_linked(sign, n, percent), "near")
    named = [] if key is None else [F.col("row").alias(key)]
    return found.select(*named, "doc_id", "n_shingles", "component_id", "kept", "stays")


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, seed: int = 17) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and any others) that stay: one of each component of :func:`near_duplicates`."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    told = _rows(docs, F.monotonically_increasing_id(), *[F.struct(*others).alias("others")] if others else [])
    sign = stored(signed(told, n, bands, rows, seed), "signatures")
    with scratch(docs.sparkSession) as keep:
        gone = keep(_linked(sign, n, percent).where("not stays").select("row"), "gone")
    return picked(sign, gone, "left_anti").select(*[F.col(c if c in ("doc_id", "text") else f"others.`{c}`").alias(c) for c in docs.columns])


def _rows(docs: DataFrame, row: Column, *more: Column) -> DataFrame:
    return docs.select(row.alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_key"), *more)


def _linked(sign: DataFrame, n: int, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept, stays of all signed rows."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "row")
    classes = stored(
        sign.where("set_hi is not null").groupBy("set_hi", "set_lo").agg(F.min("row").alias("rep"), F.min(order).alias("head")), "classes"
    )
    # the signature is a function of the set, so any row of a class serves
    reps = sign.select("row", "bands").join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    member = stored(reps.select("row", F.explode("bands").alias("band")), "bands")
    lead = member.groupBy("band").agg(F.min("row").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    busy = stored(member.join(lead, "band"), "buckets")
    sketches = sign.select("row", "n_shingles", "sketch")
    star = busy.where("row <> b").select(F.col("row").alias("a"), "b").distinct()
    star = star.join(sketches.toDF("b", "m", "sketch_b"), "b").join(sketches.toDF("a", "n", "sketch_a"), "a")
    first = stored(verified(star.where(may_link("sketch_a", "sketch_b", "n", "m", percent)), sign, n, percent), "links")
    found = components(first)
    place = busy.join(found.withColumnRenamed("id", "row"), "row", "left").select("band", "b", "row", F.coalesce("component", "row").alias("comp"))
    mixed = place.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    # pairs with the leader are known
    open_ = stored(place.where("row <> b").join(mixed, "band", "left_semi").drop("b").join(sign.select("row", "n_shingles", "sketch", "bands"), "row"), "open")
    other = open_.toDF("_row", "band", "_comp", "_n", "_sketch", "_bands")
    apart = F.expr("comp <> _comp and row > _row") & may_link("sketch", "_sketch", "n_shingles", "_n", percent)
    # a pair comes from the first band it shares; in that bucket, too, it is open or holds the leader
    apart = apart & F.expr("band = array_min(array_intersect(bands, _bands))")
    rest = open_.join(other, "band").where(apart).select(F.col("row").alias("a"), F.col("_row").alias("b"))
    more = stored(verified(rest, sign, n, percent), "links")
    found = components(first.union(more)) if more.limit(1).count() else found
    placed = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_hi", "set_lo", "head", F.coalesce("component", "rep").alias("component"))
    heads = placed.groupBy("component").agg(F.min("head").alias("first"))
    of_set = placed.join(heads, "component").select("set_hi", "set_lo", F.col("first.doc_id").alias("_label"), F.col("first.row").alias("_stays"))
    out = sign.select("row", "doc_id", "n_shingles", "set_hi", "set_lo").join(of_set, ["set_hi", "set_lo"], "left")
    label = F.when(F.col("_stays").isNull(), F.col("doc_id")).otherwise(F.col("_label"))
    return out.select(
        "row", "doc_id", "n_shingles", label.alias("component_id"), F.col("doc_id").eqNullSafe(label).alias("kept"),
        F.coalesce(F.col("row") == F.col("_stays"), F.lit(True)).alias("stays"),
    )

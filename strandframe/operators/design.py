"""Primer pairs, assembly plans and plasmid feature maps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import dna
from strandframe.functions import tables as T
from strandframe.plans import scan


#: Sequences whose candidates a task holds at once.
_HELD = 512


def _energies(turned: bool) -> np.ndarray:
    """Neighbour enthalpy and entropy in tenths by pair number 5 a + b (A, C, G, T, any other); ``turned``: of the pair read from the other strand."""
    out = np.zeros((2, 25), np.int64)
    for (x, y), both in T.NEIGHBOUR_ENERGY.items():
        a, b = "ACGT".index(x), "ACGT".index(y)
        out[:, 5 * (3 - b) + 3 - a if turned else 5 * a + b] = [round(v * 10) for v in both]
    return out


class _Region:
    """Running sums of neighbour energies, GC letters and known letters over stretches of equal width."""

    def __init__(self, texts: list[str], width: int, turned: bool):
        letters = np.frombuffer("".join(t.ljust(width) for t in texts).encode("ascii"), np.uint8).reshape(len(texts), width)
        code = np.full(256, 4, np.int64)
        code[[ord(x) for x in "ACGT"]] = range(4)
        code = code[letters]
        pair = code[:, :-1] * 5 + code[:, 1:]
        self.heat, self.order = (self._sums(e[pair]) for e in _energies(turned))
        self.gc, self.known = (self._sums(np.isin(letters, [ord(x) for x in among])) for among in ("GCS", "ACGTSW"))
        self.at_end = (code == 0) | (code == 3), (code == 1) | (code == 2)

    @staticmethod
    def _sums(values: np.ndarray) -> np.ndarray:
        return np.pad(np.cumsum(values, axis=1, dtype=np.int64), ((0, 0), (1, 0)))

    def measured(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Melting temperature and GC percent of the pieces at ``start`` (row by row)."""
        last = start + length - 1
        of = lambda sums, to: np.take_along_axis(sums, to, 1) - np.take_along_axis(sums, start, 1)
        heat, order = of(self.heat, last) / 10, of(self.order, last) / 10
        ends = [sum(np.take_along_axis(x, to, 1).astype(float) for to in (start, last)) for x in self.at_end]
        heat += ends[0] * T.END_ENERGY_AT[0] + ends[1] * T.END_ENERGY_GC[0]
        order += ends[0] * T.END_ENERGY_AT[1] + ends[1] * T.END_ENERGY_GC[1] + 0.368 * (length - 1) * math.log(50.0 * 1e-3)
        known = of(self.known, last + 1)
        share = np.where(known > 0, of(self.gc, last + 1) / np.maximum(known, 1), 0.0)
        return 1000.0 * heat / (order + 1.987 * math.log((25.0 - 25.0 / 2.0) * 1e-9)) - 273.15, share * 100


def _best_primers(rows: pd.DataFrame, product_size: int, lengths: tuple[int, int], starts: int, top: int) -> pd.DataFrame:
    """The ``top`` candidates of every row by score (two digits), start and length; all candidates of all rows are weighed together."""
    lo, hi = lengths
    start, length = (x.ravel() for x in np.meshgrid(np.arange(starts), np.arange(lo, hi + 1), indexing="ij"))
    n, zone = rows["_n"].to_numpy(np.int64)[:, None], rows["_z"].to_numpy(np.int64)[:, None]
    rev_start = np.minimum(start + product_size, n) - length
    fits = (start < rows["_k"].to_numpy(np.int64)[:, None]) & (rev_start >= start + length)
    width = starts + hi
    wide = np.broadcast_to(start, fits.shape)
    tm1, gc1 = _Region(rows["_head"].tolist(), width, False).measured(wide, length)
    tm2, gc2 = _Region(rows["_tail"].tolist(), width, True).measured(np.clip(rev_start - zone, 0, width - length), length)
    dt, dg = np.abs(tm1 - tm2), np.abs(gc1 - gc2)
    fits &= (dt < 5) & (dg < 10)
    points = lambda d: np.maximum(0.0, 10 - d)
    score = points(dt) + points(dg) + points(np.abs(length - 20))
    # candidates are in the order of start and length already
    place = np.where(fits, (3000 - np.floor(score * 100 + 0.5).astype(np.int64)) * len(start) + np.arange(len(start)), np.iinfo(np.int64).max)
    first = np.sort(np.argpartition(place, min(top, len(start)) - 1, axis=1)[:, :top], axis=1)
    row, at = np.nonzero(np.take_along_axis(fits, first, 1))
    at = first[row, at]
    lead = np.diff(row, prepend=-1) != 0
    return pd.DataFrame({
        "seq_id": rows["seq_id"].iloc[row].to_numpy(), "start": start[at], "length": length[at], "rev_start": rev_start[row, at],
        "forward": [rows["_head"].iat[r][s : s + m] for r, s, m in zip(row, start[at], length[at], strict=True)],
        "_back": [rows["_tail"].iat[r][s : s + m] for r, s, m in zip(row, rev_start[row, at] - zone[row, 0], length[at], strict=True)],
        "fwd_tm": tm1[row, at], "rev_tm": tm2[row, at], "fwd_gc": gc1[row, at], "rev_gc": gc2[row, at], "score": score[row, at],
        "_found": np.where(lead, fits.sum(axis=1)[row], 0),
    })


def primer_pairs(
    df: DataFrame, product_size: int = 500, lengths: tuple[int, int] = (18, 25), starts: int = 50, top: int = 5
) -> DataFrame:
    """Best primer pairs per sequence with the number of accepted candidates.

    Forward primers start in the first ``starts`` places; the reverse primer is
    the reverse complement of the stretch of equal length that ends the
    product.  Accepted pairs differ by less than 5 degrees and 10 GC points;
    score = max(0, 10 - difference) for both plus max(0, 10 - |length - 20|).
    All candidates of many sequences are weighed as arrays inside a task, from
    running sums over the two regions they can touch; only the best leave it.
    """
    hi = lengths[1]
    text = F.upper(F.replace("seq", F.lit(" "), F.lit("")))
    # the only letters a primer can touch: the head and the zone around the product end
    zone = lambda s: F.greatest(F.lit(0), F.least(F.lit(product_size), F.length(s)) - hi).cast("int")
    region = lambda s: F.struct(
        F.length(s).alias("_n"), F.least(F.lit(starts), F.length(s) - hi).alias("_k"), zone(s).alias("_z"),
        F.substr(s, F.lit(1), F.lit(starts + hi)).alias("_head"), F.substr(s, zone(s) + 1, F.lit(starts + hi)).alias("_tail"),
    )
    # the text is made once per row: as a plain column, filters pushed down would each make it again
    fit = F.filter(F.array(text), lambda s: (F.length(s) >= 20) & (F.length(s) > hi) & ~s.rlike("[^ACGTRYSWKMBDHVN]"))
    regions = df.select("seq_id", F.explode(F.transform(fit, region)).alias("r")).select("seq_id", "r.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _HELD):
                best = _best_primers(batch.iloc[at : at + _HELD], product_size, lengths, starts, top)
                if len(best):
                    yield best

    kind = dict(df.dtypes)["seq_id"]
    good = regions.mapInPandas(run, f"seq_id {kind}, start int, length int, rev_start int, forward string, _back string, fwd_tm double, rev_tm double, fwd_gc double, rev_gc double, score double, _found long")
    good = good.withColumn("score", F.round("score", 2)).where("seq_id is not null")
    # at most ``top`` rows of every input row are left
    rank = F.struct((-F.col("score")).alias("neg"), "start", "length")
    ranked = good.withColumn("rank", F.row_number().over(Window.partitionBy("seq_id").orderBy(rank))).withColumn("n_candidates", F.sum("_found").over(Window.partitionBy("seq_id")))
    return ranked.where(F.col("rank") <= top).select(
        "seq_id", "rank", "forward", dna.reverse_complement("_back").alias("reverse"), F.round("fwd_tm", 1).alias("fwd_tm"), F.round("rev_tm", 1).alias("rev_tm"), F.round("fwd_gc", 1).alias("fwd_gc"),
        F.round("rev_gc", 1).alias("rev_gc"), "length", (F.col("rev_start") - F.col("start") + F.col("length")).alias("product_size"), F.col("start").alias("fwd_position"),
        F.col("rev_start").alias("rev_position"), "score", "n_candidates",
    )


def _clean(seq: str = "seq") -> Column:
    return F.upper(F.replace(seq, F.lit(" "), F.lit("")))


def assembly_plan(fragments: DataFrame) -> DataFrame:
    """Method per construct of at least two fragments, by total length and count."""
    per = fragments.groupBy("construct").agg(F.count(F.lit(1)).alias("n_fragments"), F.sum(F.length(_clean())).alias("total_length")).where(F.col("n_fragments") >= 2)
    n = F.col("n_fragments")
    method = F.when((F.col("total_length") < 15000) & (n <= 6), "gibson").when(n > 6, "golden_gate").otherwise("restriction")
    return per.withColumn("method", method)


def fragment_summary(fragments: DataFrame) -> DataFrame:
    """Length, GC percent and 30-letter preview of every fragment."""
    s = _clean()
    return fragments.select(
        "construct", "ord", F.length(s).alias("length"), F.when(F.length(s) > 0, F.round(dna.letter_count(s, "GC") / F.length(s) * 100, 1)).otherwise(F.lit(0.0)).alias("gc"),
        F.concat(F.left(s, F.lit(30)), F.when(F.length(s) > 30, "...").otherwise("")).alias("preview"),
    )


def _junctions(fragments: DataFrame, size: int) -> DataFrame:
    """Every fragment that has a next one, with its last ``size`` letters.

    The next fragment is that of the next higher ``ord`` there is, so gaps in the
    numbering lose no junction; it is looked for in blocks of ``ord``.
    """
    ends = fragments.select("construct", "ord", F.right(_clean(), F.lit(size)).alias("end"), F.length("seq").alias("_len"))
    places = fragments.select("construct", "ord").distinct().withColumn("_block", scan.width_block("ord", 1 << 12))
    following = scan.running(places, ["construct"], ["ord"], "_block", [("_next", "ord", "min", "after")])
    return ends.join(following.where("_next is not null").select("construct", "ord"), ["construct", "ord"], "left_semi")


def gibson_overlaps(fragments: DataFrame, size: int = 20) -> DataFrame:
    return _junctions(fragments, size).select("construct", F.col("ord").alias("junction"), F.lit(size).alias("overlap_length"), F.col("end").alias("overlap"))


def golden_gate_overhangs(fragments: DataFrame) -> DataFrame:
    """Last four letters per junction (NNNN when shorter), repeated ones marked."""
    j = _junctions(fragments, 4).select("construct", F.col("ord").alias("junction"), F.when(F.col("_len") >= 4, F.col("end")).otherwise("NNNN").alias("overhang"))
    seen = j.groupBy("construct", "overhang").agg(F.count(F.lit(1)).alias("_n"))
    return j.join(seen, ["construct", "overhang"]).select("construct", "junction", "overhang", (F.col("_n") > 1).alias("duplicated"))


def feature_map_summary(features: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Size, feature length (overlaps counted twice) and unannotated share per plasmid."""
    per = features.groupBy("plasmid_id").agg(
        F.count(F.lit(1)).alias("n_features"), F.max("fend").alias("_end"), F.sum(F.col("fend") - F.col("fstart")).alias("feature_bp")
    )
    size = F.col("_end")
    if sizes is not None:
        per = per.join(sizes.select("plasmid_id", F.col("size").alias("_given")), "plasmid_id", "left")
        size = F.coalesce("_given", "_end")
    left = size - F.col("feature_bp")
    return per.select("plasmid_id", size.alias("size"), "n_features", "feature_bp", left.alias("unannotated_bp"), F.when(size > 0, F.round(left / size * 100, 1)).alias("unannotated_pct"))


def feature_map_text(features: DataFrame) -> DataFrame:
    """Ordered text listing per plasmid, one line per feature with arrow and size."""
    arrow = F.when(F.col("direction") == "+", "->").otherwise("<-")
    line = F.format_string("%6d..%-6d %s %s (%s, %dbp)", "fstart", "fend", arrow, "name", "ftype", F.col("fend") - F.col("fstart"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("fstart", "name", line.alias("line")))), lambda s: s["line"])
    return features.groupBy("plasmid_id").agg(F.array_join(ordered, "\n").alias("map_text"))

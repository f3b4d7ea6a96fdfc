"""Restriction sites, digests and cloning feasibility."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import tables as T
from strandframe.operators.sequence import match_starts
from strandframe.plans import letters, scan, tiles


def missing_enzymes(df: DataFrame, enzymes: dict | None = None) -> DataFrame:
    """Requested names (column ``enzyme``) that the enzyme table does not hold."""
    known = list(enzymes or T.ENZYMES)
    return df.select("enzyme").distinct().where(~F.col("enzyme").isin(known))


def _probes(names: Sequence[str], table: dict) -> list[tuple[str, str, str, int]]:
    """Name, site, letters to look for and top cut offset; both strands of sites that are not palindromes."""
    probes = []
    for name, (site, top, *bottom) in {n: table[n] for n in names if n in table}.items():
        m = len(site)
        below = bottom[0] if bottom else m - top
        read = site.upper().replace("U", "T")
        probes.append((name, site, read, top))
        back = T.reverse_complement_text(site)
        if back != site:
            probes.append((name, site, back.upper().replace("U", "T"), m - below))
    return probes


def cut_rows(df: DataFrame, names: Sequence[str] | None = None, linear: bool = True, enzymes: dict | None = None) -> DataFrame:
    """One row per cut: ``cut`` is the 1-based first base after the cut.

    An enzyme is (site, top cut offset[, bottom cut offset]), offsets from the site's
    first letter, beyond the site for type IIS; sites that are not palindromes are
    matched on both strands.  Circular sequences wrap; cuts past an end of a linear
    one do not happen.
    """
    table = enzymes or T.ENZYMES
    probes = [(name, site, T.iupac_pattern(read), off) for name, site, read, off in _probes(names or table, table)]
    longest = max(len(s) for _, s, _, _ in probes)
    text = F.translate(F.upper("seq"), "U", "T")
    n = F.length("seq")
    if not linear:
        text = F.concat(text, F.left(text, F.lit(longest - 1)))
    rows = tiles.tile_rows(df.select("seq_id", n.alias("_n"), text.alias("seq")), overlap=longest - 1)
    # one pass finds the places of any site; the few words there name their enzymes
    any_site = "|".join(sorted({rx for _, _, rx, _ in probes}))
    starts = F.filter(match_starts(F.col("tile"), any_site), lambda i: i < tiles.tile_width(longest - 1))
    words = rows.select("seq_id", "_n", "tile_start0", "tile", F.explode(starts).alias("i")).select(
        "seq_id", "_n", "tile_start0", "i", F.col("tile").substr(F.col("i") + 1, F.lit(longest)).alias("_w")
    )
    named = [
        F.when(F.col("_w").rlike(f"^{rx}"), F.struct(F.lit(name).alias("enzyme"), F.lit(site).alias("site"), F.lit(off).alias("off"), F.col("i").alias("i")))
        for name, site, rx, off in probes
    ]
    hits = words.select("seq_id", "_n", "tile_start0", F.explode(F.array_compact(F.array(*named))).alias("h"))
    start = F.col("tile_start0") + F.col("h.i")
    cut = start + F.col("h.off") + 1
    # an enzyme that cuts beside its site may cut past an end: off a linear sequence, round a circular one
    place = cut if linear else F.pmod(cut - 1, F.col("_n")) + 1
    inside = hits.where(start < F.col("_n")).select("seq_id", F.col("_n").alias("seq_length"), "h.enzyme", "h.site", place.alias("cut"))
    return (inside.where((F.col("cut") > 1) & (F.col("cut") <= F.col("seq_length"))) if linear else inside).distinct()


def restriction_sites(df: DataFrame, names: Sequence[str] | None = None, linear: bool = True, enzymes: dict | None = None) -> DataFrame:
    """Cut count and positions per sequence and enzyme."""
    return cut_rows(df, names, linear, enzymes).groupBy("seq_id", "enzyme", "site").agg(
        F.count(F.lit(1)).alias("n_cuts"), F.array_join(F.array_sort(F.collect_list("cut")), ",").alias("cut_positions")
    )


def digest_fragments(df: DataFrame, names: Sequence[str], linear: bool = True, enzymes: dict | None = None) -> DataFrame:
    """Fragments of a combined digest: n+1 pieces when linear, n when circular."""
    if linear:
        once, rest = letters.alone(df.select("seq_id", F.translate(F.upper("seq"), "U", "T").alias("seq")), "seq_id", "seq")
        found = letters.mapped(once, _linear_pieces(names, enzymes or T.ENZYMES), "seq_id", "seq", "start long, end long, size long")
        return found.unionByName(_scanned_fragments(rest, names, True, enzymes))
    return _scanned_fragments(df, names, False, enzymes)


def _linear_pieces(names: Sequence[str], table: dict):
    """Pieces of whole texts: every probe is compared at all places of a slice together."""
    probes = _probes(names, table)
    letter = {x: np.isin(np.arange(256), [ord(b) for b in T.IUPAC_BASES[x]]) for _, _, pattern, _ in probes for x in pattern}

    def find(rows: letters.Rows) -> tuple[np.ndarray, dict]:
        text, each = letters.one_byte(rows.text), rows.each()
        cuts = []
        for _, _, pattern, off in probes:
            m = len(pattern)
            if len(text) < m:
                continue
            hit = each[: len(text) - m + 1] == each[m - 1 :]
            for j, x in enumerate(pattern):
                hit &= letter[x][text[j : len(text) - m + 1 + j]]
            at = np.flatnonzero(hit)
            cut = at - rows.first[each[at]] + off
            inside = (cut > 0) & (cut < rows.size[each[at]])
            cuts.append(rows.first[each[at[inside]]] + cut[inside])
        # a piece starts at every text that has letters and at every cut
        start = np.unique(np.concatenate([rows.first[rows.size > 0], *cuts]))
        row = each[start]
        end = np.append(start[1:], len(text)) if len(start) else start
        return row, {"start": start - rows.first[row] + 1, "end": end - rows.first[row], "size": end - start}

    return find


def _scanned_fragments(df: DataFrame, names: Sequence[str], linear: bool, enzymes: dict | None) -> DataFrame:
    cuts = cut_rows(df, names, linear, enzymes).select("seq_id", "seq_length", "cut").distinct()
    marked = cuts.withColumn("_block", scan.width_block("cut", 1 << 16))
    stepped = scan.running(marked, ["seq_id"], ["cut"], "_block", [("_prev", "cut", "max", "before")])
    ends = cuts.groupBy("seq_id", "seq_length").agg(F.min("cut").alias("_first"), F.max("cut").alias("_last"))
    if linear:
        inner = stepped.select("seq_id", F.coalesce("_prev", F.lit(1)).alias("start"), (F.col("cut") - 1).alias("end")).where(F.col("end") >= F.col("start"))
        tail = ends.select("seq_id", F.col("_last").alias("start"), F.col("seq_length").cast("long").alias("end"))
        whole = df.join(ends, "seq_id", "left_anti").where(F.length("seq") > 0).select("seq_id", F.lit(1).alias("start"), F.length("seq").alias("end"))
        pieces = inner.unionByName(tail).unionByName(whole)
        return pieces.select("seq_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("end") - F.col("start") + 1).cast("long").alias("size"))
    inner = stepped.where(F.col("_prev").isNotNull()).select("seq_id", F.col("_prev").alias("start"), (F.col("cut") - 1).alias("end"), (F.col("cut") - F.col("_prev")).alias("size"))
    wrap = ends.select(
        "seq_id", F.col("_last").alias("start"), (F.col("_first") - 1).alias("end"), (F.col("seq_length") - F.col("_last") + F.col("_first")).cast("long").alias("size")
    )
    return inner.unionByName(wrap)


def cloning_check(inserts: DataFrame, first: str, second: str) -> DataFrame:
    """Whether two enzymes leave an insert whole, with its internal cut counts."""
    cuts = cut_rows(inserts, [first, second])
    per = cuts.groupBy("seq_id").agg(
        F.sum((F.col("enzyme") == first).cast("int")).alias("n_first"), F.sum((F.col("enzyme") == second).cast("int")).alias("n_second")
    )
    n1, n2 = F.coalesce("n_first", F.lit(0)), F.coalesce("n_second", F.lit(0))
    return inserts.select("seq_id").join(per, "seq_id", "left").select(
        "seq_id",
        n1.cast("long").alias("n_first"),
        n2.cast("long").alias("n_second"),
        F.when(n1 + n2 > 0, "internal site").otherwise("usable").alias("insert_status"),
    )


def double_digest_feasible(vectors: DataFrame, inserts: DataFrame, first: str, second: str) -> DataFrame:
    """Vectors cut by both enzymes, with how many inserts neither enzyme cuts."""
    in_vector = cut_rows(vectors, [first, second], linear=False).groupBy("seq_id").agg(F.count_distinct("enzyme").alias("n_enzymes"))
    whole = cloning_check(inserts, first, second).agg(F.sum((F.col("insert_status") == "usable").cast("long")).alias("n_usable_inserts"))
    return in_vector.where(F.col("n_enzymes") == 2).select("seq_id").join(F.broadcast(whole), F.lit(True))

"""Sequence statistics, translation, k-mers, open reading frames, quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import dna
from strandframe.functions import tables as T
from strandframe.plans import letters, scan, tiles

STOPS = ("TAA", "TAG", "TGA")
_SPAN = 1 << 16


def sequence_report(df: DataFrame) -> DataFrame:
    """Type, length, GC and strand forms; mass for proteins (null otherwise)."""
    kind = dna.sequence_kind("seq")
    nucleic = F.col("seq_type") != "protein"
    return df.select(
        "seq_id",
        kind.alias("seq_type"),
        F.length("seq").alias("length"),
        "seq",
    ).select(
        "seq_id",
        "seq_type",
        "length",
        F.when(nucleic, dna.gc_fraction("seq")).alias("gc_fraction"),
        F.when(nucleic, dna.gc_percent("seq")).alias("gc_percent"),
        F.when(nucleic, dna.complement("seq")).alias("complement"),
        F.when(nucleic, dna.reverse_complement("seq")).alias("reverse_complement"),
        F.when(~nucleic, dna.protein_mass("seq")).alias("molecular_weight"),
    )


def seq_stats(df: DataFrame) -> DataFrame:
    return df.select(
        "seq_id",
        F.length("seq").alias("length"),
        F.round(dna.gc_fraction("seq"), 6).alias("gc_fraction"),
        dna.gc_percent("seq").alias("gc_percent"),
    )


def six_frame(df: DataFrame, table: int = 1) -> DataFrame:
    """One row per reading frame: three for RNA, six for DNA, none for proteins."""
    kind = dna.sequence_kind("seq")
    texts = df.select("seq_id", kind.alias("_kind"), dna.known_bases("seq").alias("_f"), dna.known_bases(dna.reverse_complement("seq")).alias("_b"))
    # null where a strand has no frames
    read = texts.select(
        "seq_id", dna.frame_proteins(F.when(F.col("_kind") != "protein", F.col("_f")), table).alias("_f"), dna.frame_proteins(F.when(F.col("_kind") == "dna", F.col("_b")), table).alias("_b")
    )
    named = [F.when(F.col(c).isNotNull(), F.struct(F.lit(f"{s}{i + 1}").alias("frame"), F.get(c, F.lit(i)).alias("protein"))) for c, s in (("_f", "+"), ("_b", "-")) for i in range(3)]
    return read.select("seq_id", F.explode(F.array_compact(F.array(*named))).alias("p")).select("seq_id", "p.*")


def residue_composition(df: DataFrame) -> DataFrame:
    """Count and share of every letter per sequence."""
    counted = tiles.letter_rows(df.select("seq_id", F.upper("seq").alias("seq"))).groupBy("seq_id", "ch").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select(
        "seq_id", F.col("ch").alias("residue"), "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("seq_id")), 6).alias("share")
    )


def protein_parameters(df: DataFrame) -> DataFrame:
    """Mass, aromaticity (F, W, Y), structure-forming shares and isoelectric point.

    Shares follow helix VIYFWL, turn NPGS, sheet EMAL.  The isoelectric point is
    the pH of zero net charge, found by 50 bisection steps over
    Henderson-Hasselbalch charges (Bjellqvist pK values, general termini).
    """
    n = F.length("seq")
    among = lambda letters: sum((F.get("_l", F.lit(ord(x) - 65)) for x in letters[1:]), F.get("_l", F.lit(ord(letters[0]) - 65)))
    share = lambda letters: F.round(among(letters) / F.col("length"), 6)
    # pK of charged groups.
    positive = {"K": 10.0, "R": 12.0, "H": 5.98}
    negative = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
    counts = F.struct(*[among(x).cast("double").alias(x) for x in "KRHDECY"])
    # the letters of every text are counted once
    counted = df.select("seq_id", n.alias("length"), dna.letter_counts(F.upper("seq")).alias("_l")).where("length > 0")
    out = counted.select(
        "seq_id",
        "length",
        dna.mass_of_counts("_l", F.col("length"), T.RESIDUE_MASS).alias("molecular_weight"),
        share("FWY").alias("aromaticity"),
        share("VIYFWL").alias("helix"),
        share("NPGS").alias("turn"),
        share("EMAL").alias("sheet"),
        counts.alias("_n"),
    )

    def charge(state: Column, ph: Column) -> Column:
        total = 1 / (1 + F.pow(F.lit(10.0), ph - 7.5)) - 1 / (1 + F.pow(F.lit(10.0), 3.55 - ph))
        for x, pk in positive.items():
            total = total + state[x] / (1 + F.pow(F.lit(10.0), ph - pk))
        for x, pk in negative.items():
            total = total - state[x] / (1 + F.pow(F.lit(10.0), pk - ph))
        return total

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(14.0).alias("hi"), *[F.col(f"_n.{x}").alias(x) for x in "KRHDECY"])

    def bisect(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up_side = charge(s, mid) > 0
        return F.struct(
            F.when(up_side, mid).otherwise(s["lo"]).alias("lo"),
            F.when(up_side, s["hi"]).otherwise(mid).alias("hi"),
            *[s[x].alias(x) for x in "KRHDECY"],
        )

    point = F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, bisect, lambda s: (s["lo"] + s["hi"]) / 2)
    return out.withColumn("isoelectric_point", F.round(point, 4)).drop("_n")


def nucleic_parameters(df: DataFrame) -> DataFrame:
    return df.select(
        "seq_id",
        dna.nucleic_mass("seq").alias("mass"),
        F.round(dna.wallace_temperature("seq"), 2).alias("tm_wallace"),
        F.round(dna.neighbour_temperature("seq"), 2).alias("tm_neighbour"),
    )


def gc_skew(df: DataFrame, window: int = 100) -> DataFrame:
    """(G-C)/(G+C) of consecutive chunks with its running sum along the sequence."""
    once, rest = letters.alone(df.select("seq_id", "seq"), "seq_id", "seq")

    def skews(rows: letters.Rows) -> tuple[np.ndarray, dict]:
        text = letters.one_byte(rows.text)
        per_row = -(-rows.size // window)
        row = np.repeat(np.arange(len(per_row)), per_row)
        chunk = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        at = rows.first[row] + chunk * window
        g, c = (np.add.reduceat(np.isin(text, [ord(x) for x in both]).astype(np.int64), at) if len(at) else at for both in ("Gg", "Cc"))
        # in units of 1e-4, halves away from zero
        both = np.maximum(g + c, 1)
        units = np.sign(g - c) * ((2 * np.abs(g - c) * 10000 + both) // (2 * both))
        total = np.cumsum(units)
        lead = (np.cumsum(per_row) - per_row)[row]
        return row, {"chunk": chunk.astype(np.int32), "skew": units / 10000, "cumulative": (total - total[lead] + units[lead]) / 10000}

    found = letters.mapped(once, skews, "seq_id", "seq", "chunk int, skew double, cumulative double")
    chunks = rest.select("seq_id", F.posexplode(tiles.pieces("seq", window)).alias("chunk", "_t"))
    g, c = dna.letter_count("_t", "Gg"), dna.letter_count("_t", "Cc")
    skew = F.when(g + c > 0, F.round((g - c) / (g + c), 4)).otherwise(F.lit(0.0))
    rows = chunks.select("seq_id", "chunk", skew.alias("skew"), scan.width_block("chunk", _SPAN).alias("_block"))
    return found.unionByName(scan.running(rows, ["seq_id"], ["chunk"], "_block", [("cumulative", "skew", "sum", "upto")]).drop("_block"))


def kmer_count(df: DataFrame, k: int = 3, top: int = 10) -> DataFrame:
    """Total, distinct and the ``top`` k-mers per sequence.

    Equal counts are ordered by first occurrence; totals of sequences shorter
    than ``k`` are 0 and give no row.  A sequence is counted where it is read;
    only very long ones and repeated ids are tiled and counted over a shuffle.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    once, rest = letters.alone(df.select("seq_id", F.upper("seq").alias("seq")).where("seq_id is not null"), "seq_id", "seq")

    def count(rows: letters.Rows) -> tuple[np.ndarray, dict]:
        first, n, row = _counted(rows, k)
        kinds = np.bincount(row, minlength=len(rows.size))
        # by row, falling count, first place
        order = np.lexsort((first, -n, row))
        rank = np.arange(len(row)) - (np.cumsum(kinds) - kinds)[row[order]]
        best = order[rank < top]
        row, at = row[best], first[best]
        return row, {
            "kmer": [rows.text[i : i + k] for i in at.tolist()], "n": n[best], "rank": (rank[rank < top] + 1).astype(np.int32),
            "total_kmers": rows.size[row] - k + 1, "unique_kmers": kinds[row].astype(np.int64),
        }

    found = letters.mapped(once, count, "seq_id", "seq", "kmer string, n long, rank int, total_kmers long, unique_kmers long")
    spots = tiles.kmer_rows(rest, k)
    counted = spots.groupBy("seq_id", "kmer").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    summary = counted.groupBy("seq_id").agg(F.sum("n").alias("total_kmers"), F.count(F.lit(1)).alias("unique_kmers"))
    order = Window.partitionBy("seq_id").orderBy(F.desc("n"), "first_pos")
    best = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.unionByName(best.join(summary, "seq_id").select("seq_id", "kmer", "n", "rank", "total_kmers", "unique_kmers"))


def _counted(rows: letters.Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, count and row of every distinct window of ``k`` letters of every row."""
    at, code = letters.windows(rows, k)
    row = rows.row_of(at)
    span = int(code.max(initial=0)) + 1
    if span * len(rows.size) >= 1 << 62:
        known, code = np.unique(code, return_inverse=True)
        span = len(known) + 1
    _, spot, n = np.unique(row * span + code, return_index=True, return_counts=True)
    return at[spot], n.astype(np.int64), row[spot]


def kmer_spectrum(df: DataFrame, k: int = 3) -> DataFrame:
    """Count of every k-mer over all sequences and in how many sequences it occurs."""
    if k < 1:
        raise ValueError("k must be >= 1")
    once, rest = letters.alone(df.select("seq_id", F.upper("seq").alias("seq")), "seq_id", "seq")

    def count(rows: letters.Rows) -> tuple[np.ndarray, dict]:
        first, n, row = _counted(rows, k)
        # the windows of the rows by their letters: one number for each, as in the whole slice
        at, code = letters.windows(rows, k)
        _, spot, kind = np.unique(code[np.searchsorted(at, first)], return_index=True, return_inverse=True)
        return row[spot], {
            "kmer": [rows.text[i : i + k] for i in first[spot].tolist()],
            "n": np.bincount(kind, weights=n, minlength=len(spot)).astype(np.int64), "n_seqs": np.bincount(kind, minlength=len(spot)).astype(np.int64),
        }

    found = letters.mapped(once, count, "seq_id", "seq", "kmer string, n long, n_seqs long").drop("seq_id")
    per_seq = tiles.kmer_rows(rest, k).groupBy("kmer", "seq_id").agg(F.count(F.lit(1)).alias("n"))
    both = found.unionByName(per_seq.select("kmer", "n", F.lit(1).cast("long").alias("n_seqs")))
    return both.groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("n_seqs").alias("n_seqs"))


def _frame_marks(df: DataFrame, strands: str) -> DataFrame:
    """Start and stop codons with the next stop of their frame; ``seq`` is upper case."""
    texts = [F.struct(F.lit("+").alias("strand"), F.col("seq"))]
    if "-" in strands:
        texts.append(F.struct(F.lit("-").alias("strand"), dna.reverse_complement("seq").alias("seq")))
    both = df.select("seq_id", F.explode(F.array(*texts)).alias("s")).select("seq_id", "s.strand", "s.seq")
    marks = (
        tiles.kmer_rows(both, 3)
        .where(F.col("kmer").isin("ATG", *STOPS))
        .select(
            "seq_id",
            "strand",
            (F.col("pos") % 3 + 1).cast("int").alias("frame"),
            F.col("pos").alias("start"),
            F.when(F.col("kmer") != "ATG", F.col("pos")).alias("_stop"),
            scan.width_block("pos", _SPAN).alias("_block"),
        )
    )
    keys = ["seq_id", "strand", "frame"]
    return scan.running(marks, keys, ["start"], "_block", [("stop", "_stop", "min", "after")]).where(F.col("_stop").isNull())


def _codon_kinds() -> np.ndarray:
    """1 for ATG, 2 for stops, 0 for any other codon, by 25 a + 5 b + c (A, C, G, T, any other letter)."""
    out = np.zeros(125, np.int8)
    for codon in ("ATG", *STOPS):
        a, b, c = ("ACGT".index(x) for x in codon)
        out[25 * a + 5 * b + c] = 1 if codon == "ATG" else 2
    return out


def _base_codes(pairs: dict[str, str]) -> np.ndarray:
    out = np.full(256, 4, np.int64)
    for x, y in pairs.items():
        out[ord(x)] = "ACGT".index(y)
    return out


_FORWARD = _base_codes({x: x for x in "ACGT"})
_TURNED = _base_codes({x: y for x, y in zip(T.COMPLEMENT_FROM, T.COMPLEMENT_TO, strict=True) if y in "ACGT"})


def _outermost(rows: letters.Rows, strands: str) -> tuple[np.ndarray, ...]:
    """Row, strand, frame (0 to 2), start and stop (-1: none follows) of the outermost ATG before every stop and after the last."""
    kinds, text, each = _codon_kinds(), letters.one_byte(rows.text), rows.each()
    parts = []
    for strand in strands:
        code = (_FORWARD if strand == "+" else _TURNED)[text]
        if len(code) < 3:
            continue
        a, c = (code[:-2], code[2:]) if strand == "+" else (code[2:], code[:-2])
        kind = kinds[25 * a + 5 * code[1:-1] + c]
        kind[each[:-2] != each[2:]] = 0
        at = np.flatnonzero(kind)
        row, mark = each[at], kind[at]
        pos = at - rows.first[row]
        if strand == "-":
            pos = rows.size[row] - 3 - pos
        # codons of one frame in falling order of place: the last stop seen is the next one
        lane = row * 3 + pos % 3
        order = np.lexsort((-pos, lane))
        lane, pos, row, mark = lane[order], pos[order], row[order], mark[order]
        spot = np.maximum.accumulate(np.where(mark == 2, np.arange(len(mark)), -1))
        has = (spot >= 0) & (lane[spot] == lane) if len(mark) else np.zeros(0, bool)
        stop = np.where(has, pos[spot], -1) if len(mark) else pos
        start = mark == 1
        lane, pos, row, stop = lane[start], pos[start], row[start], stop[start]
        # of starts with one stop, the last in falling order is the outermost
        last = np.append((lane[1:] != lane[:-1]) | (stop[1:] != stop[:-1]), True)[: len(lane)]
        parts.append((row[last], np.full(int(last.sum()), strand), pos[last] % 3, pos[last], stop[last]))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _outer_frames(df: DataFrame, strands: str, least: int | None) -> DataFrame:
    """The outermost start per stop with ``least`` letters or more, stop included; ``least`` None: those that no stop follows.

    Frames of a sequence are found where it is read; only very long ones and
    repeated ids are tiled and scanned over a shuffle.
    """
    once, rest = letters.alone(df.select("seq_id", F.upper("seq").alias("seq")), "seq_id", "seq")

    def find(rows: letters.Rows) -> tuple[np.ndarray, dict]:
        row, strand, frame, start, stop = _outermost(rows, strands)
        wanted = np.flatnonzero(stop < 0 if least is None else (stop >= 0) & (stop + 3 - start >= least))
        return row[wanted], {
            "strand": strand[wanted].tolist(), "frame": (frame[wanted] + 1).astype(np.int32), "start": start[wanted],
            "stop": pa.array(stop[wanted], mask=stop[wanted] < 0),
        }

    found = letters.mapped(once, find, "seq_id", "seq", "strand string, frame int, start long, stop long")
    far = _frame_marks(rest, strands).groupBy("seq_id", "strand", "frame", "stop").agg(F.min("start").alias("start"))
    far = far.where("stop is null" if least is None else F.col("stop") + 3 - F.col("start") >= least)
    return found.unionByName(far)


def longest_orf(df: DataFrame, min_len: int = 30, table: int = 1) -> DataFrame:
    """Longest ATG..stop of the three forward frames; the first wins a tie.

    Stops are TAA, TAG and TGA for every genetic code; ``length`` includes the
    stop codon and ``end`` is exclusive.  Letters are upper-cased first.
    """
    found = _outer_frames(df, "+", min_len).withColumn("length", F.col("stop") - F.col("start") + 3)
    best = found.groupBy("seq_id").agg(F.min(F.struct((-F.col("length")).alias("neg"), "frame", "start", "stop")).alias("b"))
    joined = df.select("seq_id", "seq").join(best, "seq_id")
    length = (-F.col("b.neg")).cast("int")
    return joined.select(
        "seq_id",
        F.col("b.start").alias("start"),
        (F.col("b.stop") + 3).alias("end"),
        length.alias("length"),
        F.col("b.frame").alias("frame"),
        dna.translate(F.col("seq").substr((F.col("b.start") + 1).cast("int"), length), table, to_stop=True).alias("protein"),
    )


def all_orfs(df: DataFrame, min_len: int = 90, table: int = 11, proteins: bool = False) -> DataFrame:
    """Every complete frame of both strands, outermost ATG per stop.

    Minus-strand coordinates refer to the reverse complement.
    """
    found = _outer_frames(df, "+-", min_len).select(
        "seq_id", "strand", "frame", "start", (F.col("stop") + 3).alias("end"), (F.col("stop") + 3 - F.col("start")).alias("length_nt")
    )
    if not proteins:
        return found
    listed = found.groupBy("seq_id", "strand").agg(F.collect_list(F.struct("frame", "start", "end", "length_nt")).alias("orfs"))
    text = F.when(F.col("strand") == "-", dna.reverse_complement("seq")).otherwise(F.col("seq"))
    joined = listed.join(df.select("seq_id", "seq"), "seq_id").select("seq_id", "strand", F.explode("orfs").alias("o"), text.alias("_s"))
    return joined.select(
        "seq_id", "strand", "o.*",
        dna.translate(F.col("_s").substr((F.col("o.start") + 1).cast("int"), F.col("o.length_nt").cast("int")), table, True).alias("protein"),
    )


def truncated_orfs(df: DataFrame) -> DataFrame:
    """Per strand and frame, the outermost start that no stop follows."""
    return _outer_frames(df, "+-", None).select("seq_id", "strand", "frame", "start")


def seq_qc(df: DataFrame) -> DataFrame:
    """One summary row over all sequences (percentages with 2 digits)."""
    n_frac = dna.letter_count(F.upper("seq"), "N") / F.length("seq")
    rows = df.where(F.length("seq") > 0).select(
        F.length("seq").alias("len"), dna.gc_fraction("seq").alias("gc"), n_frac.alias("nf"), (n_frac > 0.05).cast("int").alias("flag")
    )
    return rows.agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("len").alias("total_bp"),
        F.min("len").alias("len_min"),
        F.max("len").alias("len_max"),
        F.round(F.sum("len") / F.count(F.lit(1)), 1).alias("len_avg"),
        F.round(F.min("gc") * 100, 2).alias("gc_min"),
        F.round(F.max("gc") * 100, 2).alias("gc_max"),
        F.round(F.avg("gc") * 100, 2).alias("gc_avg"),
        F.round(F.avg("nf") * 100, 2).alias("n_total"),
        F.sum("flag").alias("n_flagged"),
    )


def base_composition(df: DataFrame) -> DataFrame:
    rows = tiles.letter_rows(df.select(F.upper("seq").alias("seq")))
    return rows.groupBy(F.col("ch").alias("base")).agg(F.count(F.lit(1)).alias("n"))


def flag_ambiguous(df: DataFrame, n_max: float = 0.05) -> DataFrame:
    """Sequences whose share of N exceeds ``n_max``."""
    share = dna.letter_count(F.upper("seq"), "N") / F.length("seq")
    return df.where(F.length("seq") > 0).select("seq_id", share.alias("n_share")).where(F.col("n_share") > n_max)


def pattern_count(df: DataFrame, text: str) -> DataFrame:
    """Non-overlapping count and first index (-1 if absent) of literal letters."""
    return df.select(
        "seq_id",
        ((F.length("seq") - F.length(F.replace("seq", F.lit(text), F.lit("")))) / len(text)).cast("long").alias("n"),
        (F.instr("seq", text) - 1).alias("first_index"),
    )


def match_starts(text: Column, regex: str) -> Column:
    """Zero-based starts of all, also overlapping, matches of ``regex``.

    The text is split before every match; running lengths are the starts.
    """
    parts = F.split(text, f"(?={regex})")
    first = F.when(text.rlike(f"^(?:{regex})"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0).alias("at"), first.alias("found"))
    ends = F.aggregate(
        parts,
        start,
        lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(p))).alias("found")),
        lambda s: s["found"],
    )
    # the last running length is the end of the text, not a match
    return F.when(text.rlike(regex), F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def pattern_search(df: DataFrame, pattern: str) -> DataFrame:
    """One row per start of an IUPAC pattern, overlapping matches included."""
    rows = tiles.tile_rows(df.select("seq_id", F.upper("seq").alias("seq")), overlap=len(pattern) - 1)
    starts = F.filter(match_starts(F.col("tile"), T.iupac_pattern(pattern)), lambda i: i < tiles.tile_width(len(pattern) - 1))
    return rows.select("seq_id", "tile_start0", F.explode(starts).alias("_i")).select(
        "seq_id", (F.col("tile_start0") + F.col("_i")).alias("pos")
    )

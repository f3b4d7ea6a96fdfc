"""Literal results for sequence operators, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import dna
from strandframe.functions import tables as T
from strandframe.operators import codons, design, restriction, sequence
from strandframe.plans import tiles


def seqs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq_id long, seq string")


def column(df, name, order="seq_id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_kinds(spark):
    df = seqs(spark, "ACGTRYKMBDHVN", "ACGUACGU", "MKTAYIL", "ATGCNNSATGC", "ATGCGT--ACGT--", "MKT-L", "ATGCXX", "AUGXXA")
    out = column(df.select("seq_id", dna.sequence_kind("seq").alias("k")), "k")
    assert out == ["dna", "rna", "protein", "dna", "dna", "protein", "dna", "rna"]


def test_gc_and_complements(spark):
    df = seqs(spark, "ACGTTGCA", "ATGCXX", "ATGCGT--ACGT--", "")
    assert column(sequence.seq_stats(df), "gc_percent") == [50.0, 50.0, 50.0, 0.0]
    rc = column(df.select("seq_id", dna.reverse_complement("seq").alias("r")), "r")
    assert rc[:2] == ["TGCAACGT", "XXGCAT"]
    assert spark.range(1).select(dna.complement(F.lit("AUG"))).first()[0] == "TAC"
    assert spark.range(1).select(dna.complement(F.lit("AUG"), rna=True)).first()[0] == "UAC"


def test_translation(spark):
    one = lambda s, **k: spark.range(1).select(dna.translate(F.lit(s), **k)).first()[0]
    assert one("ATGAAATAA") == "MK*"
    assert one("ATGAAATAA", to_stop=True) == "MK"
    assert one("GCNTAR---RAYNNN") == "A*-BX"
    assert one("TGA", table=2) == "W"
    frames = {(r["seq_id"], r["frame"]): r["protein"] for r in sequence.six_frame(seqs(spark, "ATGCXX", "ATGCGT--ACGT--", "AUGXXA", "MKTL")).collect()}
    assert frames[(0, "+1")] == "MX" and frames[(1, "+1")] == "MRXR" and frames[(2, "+1")] == "MX"
    assert sum(k[0] == 2 for k in frames) == 3 and sum(k[0] == 0 for k in frames) == 6 and not any(k[0] == 3 for k in frames)


def test_unknown_code_is_an_error():
    with pytest.raises(ValueError):
        T.codon_amino(99)


def test_protein_mass(spark):
    out = column(seqs(spark, "MKTX", "ACDEFGHIKLMNPQRSTVWY").select("seq_id", dna.protein_mass("seq").alias("m")), "m")
    assert out[0] is None and out[1] == pytest.approx(2395.71, abs=0.02)


def test_gc_skew_chunks(spark):
    rows = sequence.gc_skew(seqs(spark, "ACGTTGCA"), 4).orderBy("chunk").collect()
    assert [r["skew"] for r in rows] == [0.0, 0.0]


def test_longest_orf(spark):
    df = seqs(spark, "AAATGAAACCCGGGTAATAG")
    (row,) = sequence.longest_orf(df, 9).collect()
    assert (row["start"], row["end"], row["length"], row["protein"]) == (2, 17, 15, "MKPG")
    assert sequence.longest_orf(df).count() == 0


def naive_orfs(s, min_len):
    out = set()
    for frame in range(3):
        i = frame
        while i < len(s) - 2:
            if s[i : i + 3] != "ATG":
                i += 3
                continue
            stop = next((j for j in range(i + 3, len(s) - 2, 3) if s[j : j + 3] in ("TAA", "TAG", "TGA")), None)
            if stop is None:
                i += 3
                continue
            if stop + 3 - i >= min_len:
                out.add((frame + 1, i, stop + 3))
            i = stop
    return out


def test_orfs_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(sequence, "_SPAN", 64)
    rnd = random.Random(3)
    text = "".join(rnd.choice("ACGT") for _ in range(9000))
    got = {(r["frame"], r["start"], r["end"]) for r in sequence.all_orfs(seqs(spark, text), 30).where("strand = '+'").collect()}
    assert got == naive_orfs(text, 30)
    withp = sequence.all_orfs(seqs(spark, text), 30, proteins=True).collect()
    assert all(r["protein"].startswith("M") and "*" not in r["protein"] for r in withp)


def test_kmers(spark):
    rows = sequence.kmer_count(seqs(spark, "ACGTACGT", "A"), 2).where("seq_id = 0").orderBy("rank").collect()
    assert {r["unique_kmers"] for r in rows} == {4} and rows[0]["kmer"] == "AC" and rows[0]["n"] == 2 and rows[0]["total_kmers"] == 7
    with pytest.raises(ValueError):
        tiles.kmer_rows(seqs(spark, "A"), 0)


def test_kmers_on_tile_borders(spark):
    rnd = random.Random(5)
    text = "".join(rnd.choice("ACGT") for _ in range(2 * tiles.TILE + 17))
    got = sorted((r["pos"], r["kmer"]) for r in tiles.kmer_rows(seqs(spark, text), 7).collect())
    assert got == [(i, text[i : i + 7]) for i in range(len(text) - 6)]


def test_restriction(spark):
    df = seqs(spark, "GAATTCGGATCC")
    cuts = {r["enzyme"]: r["cut_positions"] for r in restriction.restriction_sites(df, ["EcoRI", "BamHI"]).collect()}
    assert cuts == {"EcoRI": "2", "BamHI": "8"}
    sizes = sorted(r["size"] for r in restriction.digest_fragments(df, ["EcoRI", "BamHI"]).collect())
    assert sizes == [1, 5, 6]
    circular = restriction.digest_fragments(df, ["EcoRI", "BamHI"], linear=False)
    assert circular.count() == 2 and circular.agg(F.sum("size")).first()[0] == 12


def test_restriction_wraps_and_both_strands(spark):
    ring = seqs(spark, "TTCAAAGAA")
    assert restriction.cut_rows(ring, ["EcoRI"], linear=True).count() == 0
    assert [r["cut"] for r in restriction.cut_rows(ring, ["EcoRI"], linear=False).collect()] == [8]
    enzymes = {"Test": ("GGTCTC", 7, 11)}
    both = restriction.cut_rows(seqs(spark, "AAAAAAAAAAAAGGTCTCAAAAAAAAAAAAAAGAGACCAAAA"), enzymes=enzymes)
    assert both.count() == 2


def test_overlapping_sites_across_tiles(spark):
    text = "A" * (tiles.TILE - 3) + "GATCGATC" + "A" * 50
    got = sorted(r["cut"] for r in restriction.cut_rows(seqs(spark, text), ["MboI"]).collect())
    assert got == [tiles.TILE - 3 + 1, tiles.TILE + 1 + 1]


def test_codon_optimisation(spark):
    df = seqs(spark, "ATGAAACGTTAA", "GCTNNNTGA")
    rows = codons.codon_optimize(df, "human").orderBy("seq_id").collect()
    assert rows[0]["optimized_sequence"] == "ATGAAGCGCTAA" and rows[0]["codon_changes"] == 2 and rows[0]["change_rate"] == 50.0
    assert rows[1]["optimized_sequence"] == "GCCNNNTAA" and rows[1]["codon_changes"] == 1
    assert all(r["same_protein"] for r in codons.verify_backtranslation(df.where("seq_id = 0")).collect())
    with pytest.raises(ValueError):
        codons.codon_optimize(df, "martian")


def test_reverse_complement_twice(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ACGTRYKMBDHVN") for _ in range(40)) for _ in range(20)]
    df = seqs(spark, *texts).select("seq", dna.reverse_complement(dna.reverse_complement("seq")).alias("twice"))
    assert df.where("seq <> twice").count() == 0


def test_primers_are_checked(spark):
    rnd = random.Random(2)
    text = "".join(rnd.choice("ACGT") for _ in range(900))
    rows = design.primer_pairs(seqs(spark, text, "ACGT", "ACGU" * 20)).orderBy("rank").collect()
    assert rows and {r["seq_id"] for r in rows} == {0} and len(rows) <= 5
    for r in rows:
        assert text[r["fwd_position"] : r["fwd_position"] + r["length"]] == r["forward"]
        assert T.reverse_complement_text(text[r["rev_position"] : r["rev_position"] + r["length"]]) == r["reverse"]
        tm = spark.range(1).select(dna.neighbour_temperature(F.lit(r["forward"]))).first()[0]
        assert round(tm, 1) == r["fwd_tm"]


def test_plasmid_text(spark):
    df = spark.createDataFrame([(1, "ori", 200, 300, "origin", "-"), (1, "p1", 0, 100, "regulatory", "+")], "plasmid_id int, name string, fstart int, fend int, ftype string, direction string")
    text = design.feature_map_text(df).first()["map_text"].split("\n")
    assert text == ["     0..100    -> p1 (regulatory, 100bp)", "   200..300    <- ori (origin, 100bp)"]
    row = design.feature_map_summary(df).first()
    assert (row["size"], row["feature_bp"], row["unannotated_bp"], row["unannotated_pct"]) == (300, 200, 100, 33.3)

"""Annotated records, alignments, forests and reads over file splits."""

import random

import pytest

from strandframe.sources import features as A
from strandframe.sources import sequences as Q
from strandframe.sources import tables as S


def put(folder, name, text):
    (folder / name).write_text(text, newline="")
    return str(folder / name)


def test_locations():
    spots = lambda t: [(a, b, s) for _, a, b, s in A.location_parts(t)]
    assert spots("10..20") == [(9, 20, "+")] and spots("7") == [(6, 7, "+")] and spots("<1..>9") == [(0, 9, "+")]
    assert spots("join(1..3,complement(8..9),20..22)") == [(0, 3, "+"), (7, 9, "-"), (19, 22, "+")]
    assert spots("complement(join(1..3,8..9))") == [(7, 9, "-"), (0, 3, "-")]
    assert spots("complement(order(1..3,complement(8..9)))") == [(7, 9, "+"), (0, 3, "-")]
    assert spots("5^6") == [(5, 5, "+")] and spots("?..12") == [(None, 12, "+")]
    assert A.location_parts("join(J00194.1:100..202,1..5)") == [("J00194.1", 99, 202, "+"), (None, 0, 5, "+")]
    assert A.location_parts("") == [] and spots("join(1..2,(4..5") == [(0, 2, "+"), (3, 5, "+")]


def test_qualifiers():
    text = '\n/gene="a/b"\n/note="two ""quoted"" words\nand /not a key"\n/codon_start=1\n/pseudo\n/translation="MK\nLV"\n/db_xref="x:1"\n/db_xref="x:2"'
    assert A.qualifiers(text) == [
        ("gene", "a/b"), ("note", 'two "quoted" words and /not a key'), ("codon_start", "1"), ("pseudo", None), ("translation", "MKLV"), ("db_xref", "x:1"), ("db_xref", "x:2"),
    ]


TABLE = """     source          1..40
                     /organism="Testus"
     CDS             complement(join(3..8,
                     20..25))
                     /gene="x/y"
                     /note="first line
                     second line"
                     /translation="MKL
                     VV"
     misc_feature    order(1..2,complement(5..6))
                     /pseudo
"""


def check(features):
    source, cds, misc = features
    assert (source["type"], source["start0"], source["end0"], source["strand"]) == ("source", 0, 40, "+")
    assert (cds["location"], cds["start0"], cds["end0"], cds["strand"]) == ("complement(join(3..8,20..25))", 2, 25, "-")
    assert [(p["start0"], p["end0"], p["strand"]) for p in cds["parts"]] == [(19, 25, "-"), (2, 8, "-")]
    assert [(q["key"], q["value"]) for q in cds["qualifiers"]] == [("gene", "x/y"), ("note", "first line second line"), ("translation", "MKLVV")]
    assert misc["strand"] == "." and [(q["key"], q["value"]) for q in misc["qualifiers"]] == [("pseudo", None)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_genbank_and_embl_tables(spark, tmp_path, end):
    genbank = "LOCUS       G1 40 bp\nDEFINITION  a long\n            title\nACCESSION   AC1\n  ORGANISM  Testus\nFEATURES             Location/Qualifiers\n" + TABLE + "ORIGIN\n        1 acgtacgtac gtacgtacgt\n//\n"
    embl = "ID   E1; SV 1\nAC   EC1;\nDE   some\nOS   Testus\nFH   Key             Location/Qualifiers\n" + "".join(f"FT   {x[5:]}\n" for x in TABLE.splitlines()) + "SQ   Sequence 20 BP;\n     acgtacgtac gtacgtacgt        20\n//\n"
    g = Q.read_genbank(spark, put(tmp_path, "a.gb", genbank.replace("\n", end) * 2)).collect()
    e = Q.read_embl(spark, put(tmp_path, "a.embl", embl.replace("\n", end))).collect()
    assert len(g) == 2 and len(e) == 1 and g[0].description == "a long title" and g[0].seq == e[0].seq == "ACGT" * 5
    for r in (*g, *e):
        check(r.features)


def test_protein_tables(spark, tmp_path):
    old = "ID   P1 Reviewed;\nAC   Q1;\nFT   SIGNAL        1     22       Potential.\nFT   CHAIN        23   >110       Long name of\nFT                                the chain.\nFT                                /FTId=PRO_1.\nSQ   SEQUENCE\n     MKLV\n//\n"
    new = "ID   P2 Reviewed;\nAC   Q2;\nFT   CHAIN           23..?110\nFT                   /note=\"The chain\"\nFT                   /id=\"PRO_2\"\nFT   MOD_RES         5\nSQ   SEQUENCE\n     MKLV\n//\n"
    r = {x.seq_id: x.features for x in Q.read_embl(spark, put(tmp_path, "p.dat", old + new)).collect()}
    assert [(f["type"], f["start0"], f["end0"]) for f in r["Q1"]] == [("SIGNAL", 0, 22), ("CHAIN", 22, 110)]
    assert [(q["key"], q["value"]) for q in r["Q1"][1]["qualifiers"]] == [("note", "Long name of the chain"), ("id", "PRO_1")]
    assert [(f["type"], f["start0"], f["end0"], [q["value"] for q in f["qualifiers"]]) for f in r["Q2"]] == [("CHAIN", 22, 110, ["The chain", "PRO_2"]), ("MOD_RES", 4, 5, [])]


def test_phylip(spark, tmp_path):
    rows = {"one": "ACGTACGTACGTACG", "two": "AC-TACGTACGTAC-", "three": "ACGTTTTTACGTACG"}
    got = lambda text: {r.seq_id: r.aligned for r in Q.read_msa(spark, put(tmp_path, "a.phy", text), "phylip").collect()}
    blocks = "\n\n".join("\n".join((f"{k}  " if at == 0 else "  ") + v[at : at + 6] for k, v in rows.items()) for at in (0, 6, 12))
    assert got(f" 3 15\n{blocks}\n") == rows
    assert got(f" 3 15\n{blocks}\n".replace("\n  ", "\n")) == rows  # later blocks without indent
    assert got("3 15\n" + "".join(f"{k} {v}\n" for k, v in rows.items())) == rows
    assert got("3 15\n" + "".join(f"{k} {v[:8]}\n    {v[8:]}\n" for k, v in rows.items())) == rows
    assert got("1 15\none ACGTACGT ACG\nTACG\n") == {"one": rows["one"]}


def test_forest_on_any_lines(spark, tmp_path):
    p = put(tmp_path, "f.nwk", "((A:1,B:2)x:0.5,\n C:3[a comment])root;\n(D:1,E:1);\n\n(F:2,\n(G:1,H:1)y:1)z;\n")
    got = {(r.tree_id, r.child): (r.parent, r.blen) for r in S.read_newick(spark, p).collect()}
    ids = sorted({t for t, _ in got})
    assert len(ids) == 3 and {c for t, c in got if t == ids[0]} == {"A", "B", "C", "x"} and got[ids[0], "C"] == ("root", 3.0) and got[ids[0], "A"] == ("x", 1.0)
    assert {c for t, c in got if t == ids[1]} == {"D", "E"} and got[ids[2], "G"] == ("y", 1.0) and got[ids[2], "y"] == ("z", 1.0)


def test_fastq_over_splits(spark, tmp_path):
    rng = random.Random(3)
    letters = "".join(map(chr, range(33, 75)))
    reads = {f"r{i}": (s := "".join(rng.choices("ACGT", k=rng.randint(1, 80))), "@" + "".join(rng.choices(letters, k=len(s) - 1))) for i in range(900)}
    text = "".join(f"@{k} x\n{s}\n+\n{q}\n" for k, (s, q) in reads.items())
    put(tmp_path, "b.fastq", text[: len(text)])
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(c, None)}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        df = Q.read_fastq(spark, str(tmp_path / "b.fastq"))
        got = {r.seq_id: (r.seq, r.qual) for r in df.collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert got == reads
    assert spark.read.text(str(tmp_path / "b.fastq")).count() == 3600

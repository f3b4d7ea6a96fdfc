"""Signatures, species names, junctions over gaps and members of gene sets."""

from pyspark.sql import functions as F

from strandframe.operators import design, enrichment, oplog, verbs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_code_signature_pairs_a_failure_with_its_repair(spark):
    sig = lambda code: one(spark, oplog.code_signature(F.lit(code)))
    failed, fixed = "from Bio import SeqIO\nrows = SeqIO.parse(path)\nGC(rows)", "from Bio import SeqIO\nrow = SeqIO.read (path)\ngc_fraction(row)"
    assert sig(failed) == sig(fixed) == "Bio :: SeqIO.*"
    assert sig("from Bio.Seq import (Seq as S, MutableSeq)\nS.translate()\nMutableSeq.x\nSeq.y") == "Bio.Seq :: MutableSeq.*|S.*"
    assert sig("import Bio.Align\nBio.Align.PairwiseAligner()\nos.path.join(1)") == "Bio.Align :: Bio.Align.PairwiseAligner"
    assert sig("import numpy as np\nnp.mean(1)") == " :: " and sig("") == " :: "
    many = "from Bio import " + ", ".join(f"N{i}" for i in range(12)) + "\n" + "\n".join(f"N{11 - i}.go()" for i in range(12))
    assert sig(many).count(".*") == 8
    assert one(spark, oplog.code_signature(F.lit("from tool.io import Reader\nReader.open()"), "tool")) == "tool.io :: Reader.*"


def test_error_signature(spark):
    sig = lambda text: one(spark, oplog.error_signature(F.lit(text)))
    assert sig("Traceback\nKeyError: a\n  at x\nBio.ParseException:  b c\ntail") == "Bio.ParseException: b c"
    assert sig("no error line\n last line \n") == " last line" and sig("  ") == "unknown" and len(sig("TypeError: " + "x" * 300)) == 131
    assert sig("x = ValueError: inside\nplain") == "plain"


def test_species_names(spark):
    rows = {"Human": "homo_sapiens", " drosophila ": "drosophila_melanogaster", "worm": "caenorhabditis_elegans", "C.elegans": "caenorhabditis_elegans", "arabidopsis": "arabidopsis_thaliana", "rice": "oryza_sativa", "ecoli": "escherichia_coli", "Bos taurus": "bos_taurus"}
    df = spark.createDataFrame([(k,) for k in rows], "name string")
    assert {r.name: r.d for r in df.select("name", verbs.species_directory(F.col("name")).alias("d")).collect()} == rows


def test_junctions_over_gaps(spark):
    rows = [("a", 1, "AAAACCCC"), ("a", 4, "GGGGTTTT"), ("a", 9, "ACGTACGT"), ("b", 5, "TTTTAAAA"), ("c", 9000, "CCCCGGGG"), ("c", 2, "AAAATTTT")]
    df = spark.createDataFrame(rows, "construct string, ord int, seq string").repartition(3)
    got = {(r.construct, r.junction, r.overlap) for r in design.gibson_overlaps(df, 4).collect()}
    assert got == {("a", 1, "CCCC"), ("a", 4, "TTTT"), ("c", 2, "TTTT")}
    assert {(r.construct, r.junction, r.overhang, r.duplicated) for r in design.golden_gate_overhangs(df).collect()} == {("a", 1, "CCCC", False), ("a", 4, "TTTT", False), ("c", 2, "TTTT", False)}


def test_gene_set_members(spark):
    df = spark.createDataFrame([("s", "b", "H"), ("s", "a", "H"), ("s", "a", "H"), ("t", "c", "C")], "gs_name string, gene string, collection string")
    r = enrichment.gene_set_query(df, collection="H").collect()
    assert [(x.gs_name, x.n_genes, x.genes) for x in r] == [("s", 2, ["a", "b"])]

"""Readers and writers on small files, and the streaming usage report."""

import json

import pytest
from pyspark.sql import functions as F

from strandframe.operators import oplog
from strandframe.sources import sequences as Q
from strandframe.sources import tables as S
from strandframe.streaming import oplog as stream


def put(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">r1 first one\r\nACGT\r\nACGT\r\n>r2\nTT>T\n")
    rows = {r["seq_id"]: r for r in Q.preview(Q.read_fasta(spark, p)).collect()}
    assert rows["r1"]["length"] == 8 and rows["r1"]["description"] == "r1 first one" and rows["r2"]["seq_preview"] == "TT>T"
    assert Q.read_fasta(spark, p, limit=1).count() == 1 and Q.guess_format("x.GBK") == "genbank"


def test_fasta_round_trip_counts(spark, tmp_path):
    df = spark.createDataFrame([("r1", "", "ACGTACGT")], "seq_id string, description string, seq string")
    assert Q.write_fasta(df, str(tmp_path / "out")) == 1
    (row,) = Q.read_fasta(spark, str(tmp_path / "out")).collect()
    assert row["seq_id"] == "r1" and len(row["seq"]) == 8


def test_gbk_fallback(spark, tmp_path):
    p = put(tmp_path, "g.fa", ">r1 基因\nACGT\n", "gbk")
    assert Q.read_fasta(spark, p, encoding="auto").first()["description"] == "r1 基因"


def test_fastq_with_at_sign_quality(spark, tmp_path):
    p = put(tmp_path, "q.fq", "@a x\nACGT\n+\n@III\n@b\nGG\n+b\n!@\n")
    rows = {r["seq_id"]: r for r in Q.read_fastq(spark, p).collect()}
    assert rows["a"]["quality"] == [31, 40, 40, 40] and rows["b"]["quality"] == [0, 31]
    assert Q.convert_format(spark, p, str(tmp_path / "conv"), "fastq", "fasta", F.length("seq") > 2) == 1


GENBANK = '''LOCUS       TEST1  12 bp DNA
DEFINITION  a test record
ACCESSION   TEST1
SOURCE      x
  ORGANISM  Testus exemplum
FEATURES             Location/Qualifiers
     gene            complement(2..9)
                     /gene="abc"
                     /db_xref="A:1"
                     /db_xref="B:2"
     CDS             join(1..3,5..7)
                     /product="thing"
ORIGIN
        1 acgtacgtac gt
//
'''


def test_genbank(spark, tmp_path):
    r = Q.read_genbank(spark, put(tmp_path, "a.gb", GENBANK + GENBANK.replace("TEST1", "TEST2"))).orderBy("seq_id").collect()
    assert [x["seq_id"] for x in r] == ["TEST1", "TEST2"] and r[0]["seq"] == "ACGTACGTACGT" and r[0]["organism"] == "Testus exemplum"
    gene, cds = r[0]["features"]
    assert (gene["type"], gene["start0"], gene["end0"], gene["strand"]) == ("gene", 1, 9, "-")
    assert [(q["key"], q["value"]) for q in gene["qualifiers"]] == [("gene", "abc"), ("db_xref", "A:1"), ("db_xref", "B:2")]
    assert (cds["start0"], cds["end0"]) == (0, 7)


def test_embl(spark, tmp_path):
    p = put(tmp_path, "a.embl", "ID   X1; SV 1\nAC   X00001;\nDE   some\nDE   thing\nOS   Testus\nSQ   Sequence 8 BP;\n     acgtacgt        8\n//\n")
    r = Q.read_embl(spark, p).first()
    assert (r["seq_id"], r["description"], r["seq"]) == ("X00001", "some thing", "ACGTACGT")


def test_alignment_blocks(spark, tmp_path):
    p = put(tmp_path, "a.aln", "CLUSTAL W\n\ns1   ACG-\ns2   ACGT\n     ***\n\ns1   TT\ns2   TA\n")
    assert {r["seq_id"]: r["aligned"] for r in Q.read_msa(spark, p, "clustal").collect()} == {"s1": "ACG-TT", "s2": "ACGTTA"}


def test_tables(spark, tmp_path):
    t = S.read_table(spark, put(tmp_path, "a.tsv", "group\tvalue\na\t1.5\nb\t2\n"))
    assert dict(t.dtypes) == {"group": "string", "value": "double"}
    c = S.read_counts(spark, put(tmp_path, "c.csv", "gene,s1,s2\ng1,1,2\ng2,0,5\n"))
    assert c.count() == 4 and c.agg(F.sum("n")).first()[0] == 8
    g = S.read_gmt(spark, put(tmp_path, "a.gmt", "SET\tdesc\tg1\tg2\tg3\n"))
    assert [r["gene"] for r in g.orderBy("gene").collect()] == ["g1", "g2", "g3"]


def test_vcf_and_intervals(spark, tmp_path):
    v = S.read_vcf(spark, put(tmp_path, "a.vcf", "##fileformat=VCF\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nchr1\t100\t.\tAT\tA,G\t.\tPASS\tMAF=0.1;DB;END=105\n"))
    r = v.select("*", S.vcf_end0(F.col("pos"), F.col("ref"), F.col("info")).alias("end0")).first()
    assert r["alt"] == ["A", "G"] and r["qual"] is None and r["info"]["MAF"] == "0.1" and r["end0"] == 105
    b = S.read_bed(spark, put(tmp_path, "a.bed", "track x\nchr1\t99\t200\tn\t0\t+\n")).first()
    assert (b["start0"], b["end0"]) == (99, 200)
    gff = S.read_gff(spark, put(tmp_path, "a.gtf", 'chr1\tx\texon\t100\t200\t.\t-\t.\tgene_id "g1"; transcript_id "t1";\n')).first()
    assert gff["start0"] == 99 and gff["attributes"]["gene_id"] == "g1" and gff["attributes"]["transcript_id"] == "t1"


def test_pdb_models(spark, tmp_path):
    atom = "ATOM      1  CA  ALA A  15A      1.000   2.000   3.000  1.00  0.00           C\n"
    p = put(tmp_path, "1abc.pdb", "MODEL        1\n" + atom + "ENDMDL\nMODEL        2\n" + atom.replace("ATOM  ", "HETATM") + "ENDMDL\n")
    rows = S.read_pdb(spark, p).orderBy("model").collect()
    assert [(r["model"], r["hetero"], r["resseq"], r["icode"], r["x"]) for r in rows] == [(1, False, 15, "A", 1.0), (2, True, 15, "A", 1.0)]
    assert rows[0]["struct_id"] == "1abc"


def test_motif_files(spark, tmp_path):
    j = S.read_jaspar(spark, put(tmp_path, "m.jaspar", ">MA1 foo\nA [ 1 2 ]\nC [ 3 4 ]\nG [ 5 6 ]\nT [ 7 8 ]\n>MA2 bar\nA [ 1 ]\nC [ 0 ]\nG [ 0 ]\nT [ 9 ]\n"))
    assert {(r["pos"], r["letter"]): r["count"] for r in j.where("motif_id = 'MA1'").collect()}[(1, "G")] == 6.0 and j.count() == 12
    m = S.read_meme(spark, put(tmp_path, "m.meme", "MEME version 4\n\nMOTIF M1\nletter-probability matrix: alength= 4 w= 2\n 0.1 0.2 0.3 0.4\n 0.25 0.25 0.25 0.25\n"))
    assert {(r["pos"], r["letter"]): r["probability"] for r in m.collect()}[(0, "T")] == 0.4


def test_genepop(spark, tmp_path):
    p = put(tmp_path, "a.gen", "title\nL1\nL2\nPop\ni1 , 0101 0102\nPOP\ni2 , 0202 0101\n")
    rows = S.read_genepop(spark, p).orderBy("population", "locus").collect()
    assert [(r["population"], r["individual"], r["locus"], r["allele_a"], r["allele_b"]) for r in rows] == [(1, "i1", "L1", "01", "01"), (1, "i1", "L2", "01", "02"), (2, "i2", "L1", "02", "02"), (2, "i2", "L2", "01", "01")]


def test_newick(spark, tmp_path):
    p = put(tmp_path, "t.nwk", "((A:1,B:2)x:0.5,(C:3,D:4):1.5)root;\n")
    e = {r["child"]: (r["parent"], r["blen"]) for r in S.read_newick(spark, p).collect()}
    assert e["A"] == ("x", 1.0) and e["x"] == ("root", 0.5) and e["C"][0] == e["D"][0] and e[e["C"][0]] == ("root", 1.5) and len(e) == 6


MEDLINE = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><JournalIssue><PubDate><Year>2024</Year><Month>May</Month></PubDate></JournalIssue><Title>J T</Title></Journal>
<ArticleTitle>A title</ArticleTitle><ELocationID EIdType="pii">S1</ELocationID><ELocationID EIdType="doi">10.1/x</ELocationID><Abstract><AbstractText Label="AIM">why</AbstractText><AbstractText>so</AbstractText></Abstract>
<AuthorList><Author><LastName>Li</LastName><ForeName>Xu</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_xml(spark, tmp_path):
    r = S.read_medline_xml(spark, put(tmp_path, "m.xml", MEDLINE)).first()
    assert (r["pmid"], r["title"], r["abstract"], r["authors"], r["date"], r["doi"]) == ("7", "A title", "[AIM] why\nso", ["Li Xu", "The Group"], "2024 May", "10.1/x")
    blast = "<B><Iteration><Iteration_query-def>q1</Iteration_query-def><Iteration_hits><Hit><Hit_accession>H1</Hit_accession><Hit_def>vector x</Hit_def><Hit_len>9</Hit_len><Hit_hsps><Hsp><Hsp_score>50</Hsp_score><Hsp_evalue>1e-20</Hsp_evalue><Hsp_identity>8</Hsp_identity><Hsp_align-len>9</Hsp_align-len></Hsp></Hit_hsps></Hit></Iteration_hits></Iteration></B>"
    h = S.read_blast_xml(spark, put(tmp_path, "b.xml", blast)).first()
    assert (h["query"], h["hit"], h["evalue"], h["identities"], h["align_len"]) == ("q1", "H1", 1e-20, 8, 9)


def test_assembly_and_kegg(spark, tmp_path):
    regions = [{"name": n, "length": 1, "coord_system": "chromosome"} for n in ("X", "10", "2")] + [{"name": "s1", "length": 1, "coord_system": "scaffold"}]
    r = S.read_assembly_json(spark, put(tmp_path, "a.json", json.dumps({"assembly_name": "G1", "top_level_region": regions}))).first()
    assert [c["name"] for c in r["chromosomes"]] == ["2", "10", "X"] and r["scaffold_count"] == 1
    k = S.read_kegg_flat(spark, put(tmp_path, "k.txt", "ENTRY       eco00010  Pathway\nNAME        Glycolysis - Escherichia coli\nGENE        b1 a\n            b2 b\nCOMPOUND    C1\n///\nENTRY       C00031\nNAME        D-Glucose\nFORMULA     C6H12O6\nEXACT_MASS  180.0634\n///\n")).orderBy("entry").collect()
    assert k[1]["name"] == "Glycolysis" and k[1]["genes"] == ["b1 a", "b2 b"] and k[0]["formula"] == "C6H12O6" and k[0]["exact_mass"] == 180.0634


def test_log_and_memory(spark, tmp_path):
    rows = [{"ts": f"2024-01-0{d}T00:00:00Z", "op": f"o{d}", "ok": True, "event_id": d} for d in (1, 3, 2)]
    p = put(tmp_path, "log.jsonl", "\n".join(map(json.dumps, rows)) + "\n{broken\n")
    assert [r["op"] for r in oplog.log_recent(S.read_log(spark, p)).collect()] == ["o3", "o2", "o1"]
    writes = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", f"s{i % 55}", f"t{i}") for i in range(60)], "event_id int, ts string, signature string, template string").withColumn("ts", F.to_timestamp("ts"))
    kept = oplog.latest_by_signature(writes).collect()
    assert len(kept) == 50 and {r["signature"]: r["template"] for r in kept}["s4"] == "t59"
    assert spark.range(1).select(oplog.error_signature(F.lit("Traceback\n  x\nKeyError: a\nValueError: " + "z" * 200))).first()[0] == "ValueError: " + "z" * 120
    assert spark.range(1).select(oplog.error_signature(F.lit(""))).first()[0] == "unknown"


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"ts": f"2024-01-01T{h:02d}:{m:02d}:00Z", "op": "a" if m % 2 else "b", "ok": m % 5 != 0, "duration_ms": float(m), "event_id": h * 60 + m} for h in range(6) for m in range(0, 60, 7)]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    q = stream.write_usage(stream.log_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = stream.usage_by_window(S.read_log(spark, str(src)))
    closed = batch.join(got.select("window_start", "op"), ["window_start", "op"], "left_semi")
    assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.select(*got.columns).collect()))


def test_id_filter(spark):
    df = spark.createDataFrame([("a", "AC"), ("b", "GT")], "seq_id string, seq string")
    assert [r["seq_id"] for r in Q.wanted_only(df, df.where("seq_id = 'b'")).collect()] == ["b"]
    with pytest.raises(ValueError):
        Q.read_msa(spark, "x", "nexus")

"""Registered queries that write the given tables in a file format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog.base import query
from strandframe.plans.storage import scratch_path
from strandframe.sources import sequences as Q
from strandframe.sources import tables as S


def _written(x, df, stem, fmt="text", **options):
    path = scratch_path(x.spark, stem)
    df.write.format(fmt).options(**options).save(path)
    return path


@query("fasta_round_trip", "SELECT seq_id::VARCHAR AS seq_id, concat(seq_id, ' ', description) AS description, length(seq) AS length, seq FROM seqs", ["seqs"])
def _(x):
    path = scratch_path(x.spark, "fasta")
    Q.write_fasta(x.seqs, path)
    return Q.read_fasta(x.spark, path).select("seq_id", "description", F.length("seq").alias("length"), "seq")


@query("fastq_round_trip", "SELECT seq_id::VARCHAR AS seq_id, seq, repeat('I', length(seq)) AS qual, CASE WHEN length(seq) > 0 THEN 40 END AS top_quality FROM seqs WHERE length(seq) > 0", ["seqs"])
def _(x):
    path = scratch_path(x.spark, "fastq")
    Q.write_fastq(x.seqs.where("length(seq) > 0"), path)
    return Q.read_fastq(x.spark, path).select("seq_id", "seq", "qual", F.array_max("quality").alias("top_quality"))


@query("vcf_round_trip", "SELECT chrom, pos, var_id::VARCHAR AS id, ref, alt, qual, maf FROM variants", ["variants"])
def _(x):
    v = x.variants
    line = F.concat_ws("\t", "chrom", "pos", "var_id", "ref", "alt", "qual", F.lit("PASS"), F.concat(F.lit("MAF="), "maf", F.lit(";DB")))
    r = S.read_vcf(x.spark, _written(x, v.select(line.alias("value")), "vcf"))
    return r.select("chrom", "pos", "id", "ref", F.get("alt", F.lit(0)).alias("alt"), "qual", F.try_element_at("info", F.lit("MAF")).cast("double").alias("maf"))


@query("bed_round_trip", "SELECT chrom, start0, end0, iv_id::VARCHAR AS name, strand FROM ivals", ["ivals"])
def _(x):
    line = F.concat_ws("\t", "chrom", "start0", "end0", "iv_id", F.lit("0"), "strand")
    return S.read_bed(x.spark, _written(x, x.ivals.select(line.alias("value")), "bed")).select("chrom", "start0", "end0", "name", "strand")


@query("gff_round_trip", "SELECT chrom, start0, end0, strand, feat_id::VARCHAR AS id FROM feats", ["feats"])
def _(x):
    line = F.concat_ws("\t", "chrom", F.lit("x"), F.lit("gene"), F.col("start0") + 1, "end0", F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID="), "feat_id", F.lit(";Note=n")))
    r = S.read_gff(x.spark, _written(x, x.feats.select(line.alias("value")), "gff"))
    return r.select("chrom", "start0", "end0", "strand", F.try_element_at("attributes", F.lit("ID")).alias("id"))


@query("gmt_round_trip", "SELECT gs_name, gene::VARCHAR AS gene FROM gene_sets", ["gene_sets"])
def _(x):
    per = x.gene_sets.groupBy("gs_name", (F.col("gene") % 16).alias("_part")).agg(F.array_join(F.collect_list("gene"), "\t").alias("g"))
    line = F.concat_ws("\t", "gs_name", F.lit("set"), "g")
    return S.read_gmt(x.spark, _written(x, per.select(line.alias("value")), "gmt")).select("gs_name", "gene")


@query("counts_round_trip", "SELECT gene::VARCHAR AS gene, sample::VARCHAR AS sample, n FROM counts", ["counts"])
def _(x):
    wide = x.counts.groupBy("gene").pivot("sample", list(range(6))).agg(F.first("n"))
    return S.read_counts(x.spark, _written(x, wide, "counts", "csv", header=True)).where(F.col("n").isNotNull())


@query("pdb_round_trip", "SELECT chain, resseq, resname, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM atoms", ["atoms"])
def _(x):
    line = F.format_string("ATOM  %5d  CA  %3s %s%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", F.col("resseq"), "resname", "chain", "resseq", F.round("x", 3), F.round("y", 3), F.round("z", 3))
    return S.read_pdb(x.spark, _written(x, x.atoms.select(line.alias("value")), "pdb")).select("chain", F.col("resseq").cast("long").alias("resseq"), "resname", "x", "y", "z")


@query("newick_round_trip", "SELECT concat('n', c_nationkey) AS parent, concat('c', c_custkey) AS child, 0.25::DOUBLE * (1 + c_custkey % 8) AS blen FROM customer")
def _(x):
    c = x.table("customer").select("c_nationkey", F.concat(F.lit("c"), "c_custkey", F.lit(":"), F.lit(0.25) * (1 + F.col("c_custkey") % 8)).alias("leaf"), (F.col("c_custkey") % 16).alias("_part"))
    per = c.groupBy("c_nationkey", "_part").agg(F.array_join(F.collect_list("leaf"), ",").alias("l"))
    trees = per.select(F.concat(F.lit("("), "l", F.lit(")n"), "c_nationkey", F.lit(";")).alias("value"))
    return S.read_newick(x.spark, _written(x, trees, "newick")).select("parent", "child", "blen")


@query("blast_tab_round_trip", "SELECT query::VARCHAR AS query, hit::VARCHAR AS hit, round(evalue, 9) AS evalue, score FROM hsps", ["hsps"])
def _(x):
    z = F.lit("0")
    line = F.concat_ws("\t", "query", "hit", F.col("identities") * 2, "align_len", z, z, z, z, z, z, "evalue", "score")
    r = S.read_blast_tab(x.spark, _written(x, x.hsps.select(line.alias("value")), "blast"))
    return r.select("query", "hit", F.round("evalue", 9).alias("evalue"), "score")


@query("oplog_round_trip", "SELECT event_id, op, ok, duration_ms, signature::VARCHAR AS signature FROM oplog", ["oplog"])
def _(x):
    path = scratch_path(x.spark, "oplog")
    S.append_log(x.oplog.drop("props"), path)
    return S.read_log(x.spark, path).select("event_id", "op", "ok", "duration_ms", "signature")


# a plus stretch, a complement of two stretches and qualifiers with slashes, quotes and several lines
_RECORD = """LOCUS       L{id} {n} bp
DEFINITION  made from {id}
ACCESSION   A{id}
  ORGANISM  Testus {src}
FEATURES             Location/Qualifiers
     gene            1..{n}
                     /gene="g{id}/x"
     CDS             complement(join(2..5,
                     7..{n}))
                     /note="says ""{src}"" in
                     two lines"
                     /pseudo
ORIGIN
        1 {seq}
"""


def _filled(template):
    parts = [F.lit(t) if k % 2 == 0 else F.col(t).cast("string") for k, t in enumerate(template.replace("{", "\0").replace("}", "\0").split("\0"))]
    return F.concat(*parts)


def _sources(x):
    return x.seqs.where("length(seq) > 8").select(F.col("seq_id").alias("id"), F.coalesce("description", F.lit("none")).alias("src"), F.length("seq").alias("n"), F.lower("seq").alias("seq"))


_FEATURES_SQL = """WITH s AS (SELECT seq_id AS id, coalesce(description, 'none') AS src, length(seq) AS n, seq FROM seqs WHERE length(seq) > 8)
    SELECT concat('A', id) AS seq_id, concat('Testus ', src) AS organism, 'gene' AS type, concat('1..', n) AS location, 0::BIGINT AS start0, n::BIGINT AS end0, '+' AS strand, 1 AS n_parts,
        concat('gene=g', id, '/x') AS notes, md5(seq) AS seq_md5 FROM s
    UNION ALL SELECT concat('A', id), concat('Testus ', src), 'CDS', concat('complement(join(2..5,7..', n, '))'), 1, n, '-', 2, concat('note=says "', src, '" in two lines|pseudo='), md5(seq) FROM s"""


def _read_features(rows):
    flat = rows.select("seq_id", "organism", F.explode("features").alias("f"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))
    notes = F.array_join(F.transform("f.qualifiers", lambda q: F.concat(q["key"], F.lit("="), F.coalesce(q["value"], F.lit("")))), "|")
    return flat.select("seq_id", "organism", "f.type", "f.location", "f.start0", "f.end0", "f.strand", F.size("f.parts").alias("n_parts"), notes.alias("notes"), "seq_md5")


@query("genbank_round_trip", _FEATURES_SQL, ["seqs"])
def _(x):
    path = _written(x, _sources(x).select(_filled(_RECORD).alias("value")), "genbank", lineSep="//\n")
    return _read_features(Q.read_genbank(x.spark, path))


_EMBL = "\n".join(
    ["ID   L{id}; SV 1;", "AC   A{id};", "DE   made from {id}", "OS   Testus {src}"]
    + [f"FT{line[2:]}" for line in _RECORD.split("\n")[5:12]] + ["SQ   Sequence {n} BP;", "     {seq} {n}", ""]
)


@query("embl_round_trip", _FEATURES_SQL, ["seqs"])
def _(x):
    path = _written(x, _sources(x).select(_filled(_EMBL).alias("value")), "embl", lineSep="//\n")
    return _read_features(Q.read_embl(x.spark, path))


@query("phylip_round_trip", "SELECT concat('s', seq_id) AS seq_id, aligned FROM msa", ["msa"])
def _(x):
    """One interleaved file per alignment and hundred ids: blocks of 24 columns, ids in the first only."""
    width = 24
    rows = x.msa.withColumn("_file", F.concat_ws("_", "aln_id", F.floor(F.col("seq_id") / 100).cast("string")))
    block = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_id", "aligned"))), lambda r: F.concat(F.concat(F.lit("s"), r["seq_id"], F.lit(" ")) if at == 0 else F.lit(""), F.substring(r["aligned"], at + 1, width))), "\n")
    text = F.concat(F.count(F.lit(1)).cast("string"), F.lit(" 64\n"), F.concat_ws("\n\n", *[block(at) for at in range(0, 64, width)]))
    files = rows.groupBy("_file").agg(text.alias("value"))
    path = scratch_path(x.spark, "phylip")
    files.write.partitionBy("_file").text(path)
    return Q.read_msa(x.spark, path + "/*", "phylip")

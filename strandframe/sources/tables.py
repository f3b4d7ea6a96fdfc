"""Interval, variant, matrix, motif, tree, structure, search and literature files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.plans import scan
from strandframe.sources.text import numbered_lines, records


def read_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV or TSV (by extension) with header and inferred types."""
    sep = sep or ("\t" if path.lower().rstrip("/").endswith((".tsv", ".tab")) else ",")
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep)


def read_matrix(spark: SparkSession, path: str, row: str = "gene", column: str = "sample", value: str = "n", kind: str = "long") -> DataFrame:
    """Wide matrix with the row key first, as a long table."""
    wide = spark.read.csv(path, header=True)
    key, *cols = wide.columns
    long = wide.select(F.col(key).alias(row), *cols).unpivot(row, cols, column, value)
    return long.withColumn(value, F.col(value).cast(kind))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return read_matrix(spark, path)


def read_otu(spark: SparkSession, path: str, taxa_are_rows: bool = True) -> DataFrame:
    if taxa_are_rows:
        return read_matrix(spark, path, "otu", "sample", "abundance", "double")
    return read_matrix(spark, path, "sample", "otu", "abundance", "double").select("otu", "sample", "abundance")


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    # name and description are taken before the genes are exploded: beside them, the line would be split again for every gene
    lines = spark.read.text(path).where(F.size(parts) > 2).select(
        F.get(parts, F.lit(0)).alias("gs_name"), F.get(parts, F.lit(1)).alias("description"), F.slice(parts, F.lit(3), F.size(parts)).alias("_genes")
    )
    return lines.select("gs_name", "description", F.explode("_genes").alias("gene")).where(F.col("gene") != "")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants with the ALT list and INFO map (flags map to an empty text)."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string")
    return raw.select(
        "chrom", "pos", "id", "ref", F.split("alt", ",").alias("alt"), F.expr("try_cast(qual AS DOUBLE)").alias("qual"), "filter",
        F.when(F.col("info") != ".", F.str_to_map("info", F.lit(";"), F.lit("="))).alias("info"),
    )


def vcf_end0(pos: Column, ref: Column, info: Column) -> Column:
    """Half-open end: INFO END is one-based inclusive, else the REF length."""
    return F.coalesce(F.try_element_at(info, F.lit("END")).cast("long"), pos - 1 + F.length(ref))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.col("value") != ""))
    p = F.split("value", "\t")
    return raw.select(
        F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).cast("long").alias("start0"), F.get(p, F.lit(2)).cast("long").alias("end0"),
        F.get(p, F.lit(3)).alias("name"), F.expr("try_cast(get(split(value, '\t'), 4) AS DOUBLE)").alias("score"), F.get(p, F.lit(5)).alias("strand"),
    )


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 / GTF rows in half-open coordinates with an attribute map."""
    raw = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chrom string, source string, type string, start1 long, end1 long, score string, strand string, phase string, attributes string")
    gtf = F.col("attributes").rlike(r'^\s*\w+ "')
    gff3 = F.str_to_map("attributes", F.lit(";"), F.lit("="))
    flat = F.regexp_replace(F.regexp_replace("attributes", r'\s*(\w+) "([^"]*)"\s*', "$1=$2"), ";$", "")
    return raw.select("chrom", "type", (F.col("start1") - 1).alias("start0"), F.col("end1").alias("end0"), "strand", F.when(gtf, F.str_to_map(flat, F.lit(";"), F.lit("="))).otherwise(gff3).alias("attributes"))


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).where(F.col("value").rlike(r"^\d"))
    p = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    return raw.select(
        p(0).cast("long").alias("matches"), p(1).cast("long").alias("mismatches"), p(8).alias("strand"), p(9).alias("query"), p(11).cast("long").alias("q_start0"), p(12).cast("long").alias("q_end0"),
        p(13).alias("chrom"), p(15).cast("long").alias("start0"), p(16).cast("long").alias("end0"),
    )


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-column ATOM and HETATM rows; the structure id is the file name."""
    lines = numbered_lines(spark, path)
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    marked = lines.withColumn("_m", F.when(F.col("value").startswith("MODEL"), F.expr("try_cast(trim(substring(value, 7, 8)) AS INT)"))).withColumn("_block", scan.width_block("line", 1 << 16))
    numbered = scan.running(marked, ["file"], ["line"], "_block", [("model", "_m", "max", "upto")])
    atoms = numbered.where(F.col("value").rlike("^(ATOM  |HETATM)"))
    return atoms.select(
        F.regexp_extract("file", r"([^/]+?)(\.\w+)?$", 1).alias("struct_id"), F.coalesce("model", F.lit(1)).alias("model"), cut(22, 1).alias("chain"), cut(23, 4).cast("int").alias("resseq"),
        cut(27, 1).alias("icode"), F.col("value").startswith("HETATM").alias("hetero"), cut(18, 3).alias("resname"), cut(13, 4).alias("atom"),
        cut(31, 8).cast("double").alias("x"), cut(39, 8).cast("double").alias("y"), cut(47, 8).cast("double").alias("z"),
    )


def read_mmcif(spark: SparkSession, path: str) -> DataFrame:
    """Atom-site rows in the standard archive column order."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.col("value").rlike(r"^(ATOM|HETATM)\s"))
    p = lambda i: F.get(F.split(F.trim("value"), r"\s+"), F.lit(i))
    return rows.select(
        F.regexp_extract("file", r"([^/]+?)(\.\w+)?$", 1).alias("struct_id"), p(20).cast("int").alias("model"), p(18).alias("chain"), p(16).cast("int").alias("resseq"),
        F.when(p(9) == "?", "").otherwise(p(9)).alias("icode"), (p(0) == "HETATM").alias("hetero"), p(5).alias("resname"), p(3).alias("atom"),
        p(10).cast("double").alias("x"), p(11).cast("double").alias("y"), p(12).cast("double").alias("z"),
    )


def read_blast_tab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(
        path, sep="\t", comment="#",
        schema="query string, hit string, identity_pct double, align_len long, mismatches long, gap_opens long, q_start long, q_end long, s_start long, s_end long, evalue double, score double",
    )


def read_blast_xml(spark: SparkSession, path: str) -> DataFrame:
    """Segments from the XML report, with the query of their iteration."""
    hsp = "STRUCT<`Hsp_evalue`: DOUBLE, `Hsp_bit-score`: DOUBLE, `Hsp_score`: DOUBLE, `Hsp_identity`: LONG, `Hsp_align-len`: LONG>"
    hit = f"STRUCT<Hit_accession: STRING, Hit_def: STRING, Hit_len: LONG, Hit_hsps: STRUCT<Hsp: ARRAY<{hsp}>>>"
    raw = spark.read.format("xml").option("rowTag", "Iteration").schema(f"`Iteration_query-def` STRING, Iteration_hits STRUCT<Hit: ARRAY<{hit}>>").load(path)
    hits = raw.select(F.col("Iteration_query-def").alias("query"), F.explode("Iteration_hits.Hit").alias("h"))
    segs = hits.select("query", F.col("h.Hit_accession").alias("hit"), F.col("h.Hit_def").alias("description"), F.explode("h.Hit_hsps.Hsp").alias("s"))
    return segs.select("query", "hit", "description", F.col("s.Hsp_evalue").alias("evalue"), F.col("s.Hsp_score").alias("score"), F.col("s.Hsp_identity").alias("identities"), F.col("s.`Hsp_align-len`").alias("align_len"))


def read_jaspar(spark: SparkSession, path: str) -> DataFrame:
    rows = records(spark, path, "\n>").select(F.regexp_replace("value", "^>", "").alias("v")).where(F.trim("v") != "")
    per = rows.select(F.regexp_extract("v", r"^(\S+)", 1).alias("motif_id"), F.regexp_extract("v", r"^\S+[ \t]+(\S+)", 1).alias("name"), F.explode(F.array(*[F.struct(F.lit(x).alias("letter"), F.regexp_extract("v", rf"(?m)^\s*{x}\s*\[?([\d.\s]+?)\]?\s*$", 1).alias("row")) for x in "ACGT"])).alias("r"), "v")
    return per.select("motif_id", "name", F.col("r.letter").alias("letter"), F.posexplode(F.split(F.regexp_replace("r.row", r"^\s+|\s+$", ""), r"\s+")).alias("pos", "_c")).select("motif_id", "name", "pos", "letter", F.col("_c").cast("double").alias("count"))


def read_meme(spark: SparkSession, path: str) -> DataFrame:
    """Probability matrices of a MEME text file."""
    rows = records(spark, path, "MOTIF ").where(F.col("value").contains("letter-probability matrix"))
    body = F.regexp_extract("value", r"(?s)letter-probability matrix[^\n]*\n((?:\s*[\d.eE+\-]+(?:[ \t]+[\d.eE+\-]+){3}[ \t]*\n?)+)", 1)
    lines = rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("motif_id"), F.posexplode(F.split(F.regexp_replace(body, r"^\s+|\s+$", ""), r"\s*\n\s*")).alias("pos", "_l"))
    return lines.select("motif_id", "pos", F.posexplode(F.split(F.trim("_l"), r"\s+")).alias("_i", "_v")).select("motif_id", "pos", F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), F.col("_i") + 1).alias("letter"), F.col("_v").cast("double").alias("probability"))


def read_genepop(spark: SparkSession, path: str) -> DataFrame:
    """Genotypes per population, individual and locus, as written and as allele pair.

    Loci are the lines (or one comma list) before the first ``Pop``.
    """
    lines = numbered_lines(spark, path).where((F.col("line") > 0) & (F.trim("value") != ""))
    marked = lines.withColumn("_p", F.lower(F.trim("value")).eqNullSafe("pop").cast("int")).withColumn("_block", scan.width_block("line", 1 << 16))
    seen = scan.running(marked, ["file"], ["line"], "_block", [("population", "_p", "sum", "upto")]).where("_p = 0")
    names = seen.where("population = 0").select("file", "line", F.posexplode(F.split("value", r"\s*,\s*")).alias("_j", "locus"))
    order = Window.partitionBy("file").orderBy("line", "_j")  # the locus list of a header
    loci = names.select("file", F.trim("locus").alias("locus"), (F.row_number().over(order) - 1).alias("_i"))
    rows = seen.where("population > 0").select("file", "population", F.trim(F.split_part("value", F.lit(","), F.lit(1))).alias("individual"), F.posexplode(F.split(F.trim(F.split_part("value", F.lit(","), F.lit(2))), r"\s+")).alias("_i", "genotype"))
    half = (F.length("genotype") / 2).cast("int")
    return rows.join(loci, ["file", "_i"]).select("population", "individual", "locus", "genotype", F.left("genotype", half).alias("allele_a"), F.right("genotype", half).alias("allele_b"))


def newick_edges(trees: DataFrame) -> DataFrame:
    """Edge table of tree texts ``(tree_id, newick)``.

    Every name and closing bracket is a node.  A node of depth d hangs on the
    next closing bracket that ends at depth d - 1.  Inner nodes without a label
    are named by their place.
    """
    token = r"\(|\)[^,():;]*(?::[^,():;]+)?|[^,():;\s]+(?::[^,():;]+)?"
    t = trees.select("tree_id", F.posexplode(F.regexp_extract_all("newick", F.lit(token), F.lit(0))).alias("i", "tok"))
    w = Window.partitionBy("tree_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # one tree text
    step = F.when(F.col("tok") == "(", 1).when(F.col("tok").startswith(")"), -1).otherwise(0)
    label = F.regexp_extract("tok", r"^\)?([^:]*)", 1)
    nodes = t.withColumn("depth", F.sum(step).over(w)).where(F.col("tok") != "(").select(
        "tree_id", "i", "depth", F.col("tok").startswith(")").alias("inner"), F.when(label == "", F.concat(F.lit("node"), "i")).otherwise(label).alias("name"),
        F.expr("try_cast(nullif(regexp_extract(tok, ':(.+)$', 1), '') AS DOUBLE)").alias("blen"),
    )
    as_child = nodes.where("depth > 0").select("tree_id", "i", (F.col("depth") - 1).alias("_k"), F.col("name").alias("child"), "blen", F.lit(None).cast("string").alias("_p"))
    as_parent = nodes.where("inner").select("tree_id", "i", F.col("depth").alias("_k"), F.lit(None).cast("string").alias("child"), F.lit(None).cast("double").alias("blen"), F.col("name").alias("_p"))
    ahead = Window.partitionBy("tree_id", "_k").orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    return as_child.unionByName(as_parent).withColumn("parent", F.first("_p", ignorenulls=True).over(ahead)).where(F.col("child").isNotNull()).select("tree_id", "child", "parent", "blen")


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """Trees of a file, one per ``;`` on however many lines; the id is the file name and place.

    Comments in square brackets are left out; neither they nor labels may hold ``;``.
    """
    texts = spark.read.option("lineSep", ";").text(path).where(F.col("value").rlike(r"\S"))
    rows = texts.select(
        F.regexp_replace("value", r"\[[^\]]*\]", "").alias("newick"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id")
    )
    # trees of one split in order, splits of a file in order
    splits = rows.groupBy("file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    name = F.regexp_extract("file", r"([^/]+?)(\.\w+)?$", 1)
    place = F.col("_off") + F.col("_id") - F.col("_first")
    numbered = rows.join(starts, ["file", "_split"]).select(F.concat_ws(":", name, place.cast("string")).alias("tree_id"), "newick")
    return newick_edges(numbered)


def read_medline_xml(spark: SparkSession, path: str) -> DataFrame:
    """PubmedArticle rows: sectioned abstracts as ``[Label] text``, collective authors, DOI by attribute."""
    text = "STRUCT<_VALUE: STRING, _Label: STRING>"
    schema = (
        "MedlineCitation STRUCT<PMID: STRING, Article: STRUCT<ArticleTitle: STRING, Abstract: STRUCT<AbstractText: ARRAY<" + text + ">>, "
        "Journal: STRUCT<Title: STRING, JournalIssue: STRUCT<PubDate: STRUCT<Year: STRING, Month: STRING>>>, "
        "AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, ForeName: STRING, CollectiveName: STRING>>>, "
        "ELocationID: ARRAY<STRUCT<_VALUE: STRING, _EIdType: STRING>>>>"
    )
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path)
    a = "MedlineCitation.Article."
    sections = F.transform(a + "Abstract.AbstractText", lambda s: F.when(s["_Label"].isNotNull(), F.concat(F.lit("["), s["_Label"], F.lit("] "), s["_VALUE"])).otherwise(s["_VALUE"]))
    people = F.transform(a + "AuthorList.Author", lambda p: F.coalesce(p["CollectiveName"], F.concat_ws(" ", p["LastName"], p["ForeName"])))
    dois = F.filter(a + "ELocationID", lambda e: (e["_EIdType"] == "doi") | e["_VALUE"].startswith("doi"))
    return raw.select(
        F.col("MedlineCitation.PMID").alias("pmid"), F.col(a + "ArticleTitle").alias("title"), F.coalesce(F.array_join(sections, "\n"), F.lit("")).alias("abstract"),
        F.coalesce(people, F.array().cast("array<string>")).alias("authors"), F.col(a + "Journal.Title").alias("journal"),
        F.concat_ws(" ", a + "Journal.JournalIssue.PubDate.Year", a + "Journal.JournalIssue.PubDate.Month").alias("date"),
        F.coalesce(F.trim(F.replace(F.get(dois, F.lit(0))["_VALUE"], F.lit("doi:"), F.lit(""))), F.lit("")).alias("doi"),
    )


LOG_SCHEMA = "ts timestamp, kind string, op string, ok boolean, duration_ms double, error string, code_hash string, code_preview string, cache_hit boolean, event_id long, signature string"


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """JSON-lines log; broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(log: DataFrame, path: str) -> None:
    """Append records in one folder per day; ``ts`` defaults to now."""
    stamped = log if "ts" in log.columns else log.withColumn("ts", F.current_timestamp())
    stamped.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.partitionBy("day").mode("append").json(path)


def read_assembly_json(spark: SparkSession, path: str) -> DataFrame:
    """Assembly description: chromosomes (numbers first, then names) and scaffold count."""
    region = "STRUCT<name: STRING, length: LONG, coord_system: STRING>"
    raw = spark.read.option("multiLine", True).schema(f"assembly_name STRING, assembly_accession STRING, assembly_date STRING, karyotype ARRAY<STRING>, top_level_region ARRAY<{region}>").json(path)
    chroms = F.filter("top_level_region", lambda r: r["coord_system"] == "chromosome")
    keyed = F.transform(chroms, lambda r: F.struct(F.coalesce(F.when(r["name"].rlike(r"^\d+$"), r["name"].cast("int")), F.lit(99)).alias("k"), F.when(r["name"].rlike(r"^\d+$"), "").otherwise(r["name"]).alias("t"), r["name"].alias("name"), r["length"].alias("length")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["name"].alias("name"), s["length"].alias("length")))
    return raw.select("assembly_name", "assembly_accession", "assembly_date", "karyotype", ordered.alias("chromosomes"), (F.size("top_level_region") - F.size(chroms)).alias("scaffold_count"))


def read_kegg_flat(spark: SparkSession, path: str) -> DataFrame:
    """Flat pathway, reaction and compound entries with their gene list."""
    rows = records(spark, path, "///\n").where(F.col("value").contains("ENTRY"))
    v = F.col("value")
    one = lambda k: F.nullif(F.regexp_extract(v, rf"(?m)^{k}[ \t]+([^\n]*)$", 1), F.lit(""))
    genes = F.split(F.trim(F.regexp_extract(v, r"(?m)^GENE[ \t]+([^\n]*(?:\n[ \t]+[^\n]*)*)", 1)), r"\n\s+")
    return rows.select(
        F.regexp_extract(v, r"ENTRY\s+(\S+)", 1).alias("entry"), F.regexp_replace(one("NAME"), " - .*$", "").alias("name"), one("DESCRIPTION").alias("description"),
        F.filter(genes, lambda g: g != "").alias("genes"), one("EQUATION").alias("equation"), one("ENZYME").alias("enzyme"), one("FORMULA").alias("formula"), one("EXACT_MASS").cast("double").alias("exact_mass"),
    )


def read_kegg_list(spark: SparkSession, path: str) -> DataFrame:
    """Listing lines ``id<TAB>name``; an organism suffix after `` - `` is dropped."""
    p = F.split("value", "\t")
    return spark.read.text(path).where(F.size(p) > 1).select(F.get(p, F.lit(0)).alias("id"), F.regexp_replace(F.get(p, F.lit(1)), " - [^-]*$", "").alias("name"))


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("errorifexists").csv(path, header=True, sep=sep)


def write_motif(motif: DataFrame, path: str) -> None:
    """Weight matrix as TSV, one row per position and one column per letter."""
    motif.groupBy("motif_id", "pos").pivot("letter", list("ACGT")).agg(F.first("weight")).write.mode("errorifexists").csv(path, header=True, sep="\t")

"""Sequence files: FASTA, FASTQ, GenBank / EMBL / Swiss-Prot, alignments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.plans.scan import row_positions
from strandframe.plans.storage import stored
from strandframe.sources.features import with_features
from strandframe.sources.text import lenient_text, numbered_lines, records

# Quality offsets of the three FASTQ encodings.
QUALITY_OFFSET = {"sanger": 33, "illumina": 64, "solexa": 64}
_FORMATS = {"fasta": ("fa", "fasta", "fna", "ffn", "faa", "fas"), "genbank": ("gb", "genbank", "gbk")}


def guess_format(path: str) -> str:
    end = path.lower().rsplit(".", 1)[-1]
    return next((f for f, ends in _FORMATS.items() if end in ends), "fasta")


def read_fasta(spark: SparkSession, path: str, limit: int | None = None, encoding: str = "utf-8") -> DataFrame:
    """Records with id (first word), description (whole header) and sequence.

    ``encoding='auto'`` decodes records that are not valid UTF-8 as GBK;
    ``limit`` keeps that many records for a preview.
    """
    rows = records(spark, path, "\n>")
    value = lenient_text(spark, F.col("value")) if encoding == "auto" else F.col("value")
    body = F.regexp_replace(F.regexp_replace(value, "^>", ""), "\r", "")
    cut = rows.select(body.alias("_b")).where(F.trim("_b") != "")
    head = F.split_part("_b", F.lit("\n"), F.lit(1))
    seq = F.regexp_replace(F.expr("substr(_b, length(split_part(_b, '\n', 1)) + 1)"), r"\s+", "")
    out = cut.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("seq_id"), head.alias("description"), seq.alias("seq"))
    return out.limit(limit) if limit else out


def preview(df: DataFrame, letters: int = 100) -> DataFrame:
    """Summary of records: length and the first letters."""
    return df.select("seq_id", "description", F.length("seq").alias("length"), F.left("seq", F.lit(letters)).alias("seq_preview"))


def read_fastq(spark: SparkSession, path: str, encoding: str = "sanger") -> DataFrame:
    """Four-line reads with quality values, also where a quality line starts with ``@``.

    Reads are put together where their lines lie: a first pass counts the lines of
    every file split, which tells where in a read each split begins.  Only the lines
    of reads that cross a split's edge are shuffled.  Empty lines are skipped.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")).where("value <> ''")
    splits = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # one row per split
    starts = splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = stored(lines.join(F.broadcast(starts), ["file", "split"]).mapInPandas(_reads, _READS), "reads")
    edges = placed.where("part is not null").groupBy("file", "read").agg(*[F.max(F.when(F.col("part") == k, F.col(c))).alias(c) for k, c in ((0, "head"), (1, "seq"), (3, "qual"))])
    reads = placed.where("part is null").select("head", "seq", "qual").unionByName(edges.select("head", "seq", "qual"))
    return reads.select(F.substring(F.split_part("head", F.lit(" "), F.lit(1)), 2, 1 << 20).alias("seq_id"), "seq", "qual", quality_values(F.col("qual"), encoding).alias("quality"))


_READS = "file string, read long, part int, head string, seq string, qual string"


def _reads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole reads of every split (``part`` null) and the lines of reads that lie in two (one row a line)."""
    columns = ["file", "read", "part", "head", "seq", "qual"]
    place, at, held = None, 0, []

    def loose(lines: list[tuple[int, str]], file: str) -> list[tuple]:
        return [(file, n // 4, n % 4, *[text if n % 4 == k else None for k in (0, 1, 3)]) for n, text in lines]

    for batch in batches:
        out = []
        for value, file, split, first in zip(batch["value"], batch["file"], batch["split"], batch["first"], strict=True):
            if place != (file, split):
                if held:
                    out += loose(held, place[0])
                place, at, held = (file, split), int(first), []
            held.append((at, value))
            at += 1
            if at % 4 == 0:
                if len(held) == 4:
                    out.append((file, at // 4 - 1, None, held[0][1], held[1][1], held[3][1]))
                else:
                    out += loose(held, file)
                held = []
        yield pd.DataFrame(out, columns=columns).astype({"part": "Int32"})
    if held:
        yield pd.DataFrame(loose(held, place[0]), columns=columns).astype({"part": "Int32"})


def quality_values(qual: Column, encoding: str = "sanger") -> Column:
    offset = QUALITY_OFFSET[encoding]
    return F.transform(F.regexp_extract_all(qual, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c) - offset)


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Annotated records with a feature array and upper-case sequence.

    A feature has its type, location text, outer ends, strand (``.`` if mixed), all
    stretches of nested locations and its qualifiers in order, repeated ones kept.
    """
    rows = records(spark, path, "\n//").where(F.col("value").contains("LOCUS"))
    v = F.regexp_replace("value", "\r", "")
    table = F.regexp_extract(v, r"(?s)\nFEATURES[^\n]*\n(.*?)(?=\n\S|$)", 1)
    origin = F.regexp_extract(v, r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)
    definition = F.regexp_replace(F.regexp_extract(v, r"(?s)\nDEFINITION\s+(.*?)(?=\n\S|$)", 1), r"\s*\n\s+", " ")
    read = rows.select(
        F.regexp_extract(v, r"LOCUS\s+(\S+)", 1).alias("name"), F.regexp_extract(v, r"\nACCESSION\s+(\S+)", 1).alias("seq_id"),
        definition.alias("description"), F.regexp_extract(v, r"\n\s+ORGANISM\s+([^\n]*)", 1).alias("organism"),
        table.alias("_table"), F.upper(F.regexp_replace(origin, r"[\d\s/]", "")).alias("seq"),
    )
    return with_features(read, "_table", "genbank").select("name", "seq_id", "description", "organism", "features", "seq")


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """EMBL and Swiss-Prot records: id, description, organism, features, sequence.

    Features are those of :func:`read_genbank`; the older Swiss-Prot table, with
    places in columns, gives its description as qualifier ``note``.
    """
    rows = records(spark, path, "\n//").where(F.col("value").rlike(r"(?m)^ID   "))
    v = F.regexp_replace("value", "\r", "")
    lines = lambda code: F.regexp_extract_all(v, F.lit(rf"(?m)^{code}   ([^\n]*)$"), F.lit(1))
    read = rows.select(
        F.regexp_extract(v, r"(?m)^ID   ([^\s;]+)", 1).alias("name"), F.regexp_extract(v, r"\nAC   ([^\s;]+)", 1).alias("seq_id"),
        F.array_join(lines("DE"), " ").alias("description"), F.array_join(lines("OS"), " ").alias("organism"),
        F.array_join(F.transform(lines("FT"), lambda x: F.concat(F.lit("FT   "), x)), "\n").alias("_table"),
        F.upper(F.regexp_replace(F.regexp_extract(v, r"(?s)\nSQ   [^\n]*\n(.*)$", 1), r"[\d\s/]", "")).alias("seq"),
    )
    return with_features(read, "_table", "embl").select("name", "seq_id", "description", "organism", "features", "seq")


def read_msa(spark: SparkSession, path: str, fmt: str = "fasta") -> DataFrame:
    """Aligned rows; interleaved clustal, stockholm and phylip blocks are joined.

    Clustal and stockholm repeat the id in every block.  PHYLIP states the number of
    rows and columns first and gives ids in its first block only: text row i of a
    later block belongs to row i.  If the first block's first row already has all
    columns or the rows go on one after another, the file is read as sequential.
    """
    if fmt == "fasta":
        return read_fasta(spark, path).select("seq_id", F.col("seq").alias("aligned"))
    if fmt not in ("clustal", "stockholm", "phylip"):
        raise ValueError("fmt must be fasta, clustal, stockholm or phylip")
    lines = numbered_lines(spark, path, blank=fmt != "phylip")
    if fmt == "clustal":
        lines = lines.where(F.col("value").rlike(r"^\S") & ~F.col("value").rlike("^(CLUSTAL|MUSCLE)"))
    elif fmt == "stockholm":
        lines = lines.where(F.col("value").rlike(r"^[^#/\s]"))
    else:
        return _phylip(lines)
    cut = lines.select("file", "line", F.regexp_extract("value", r"^(\S+)\s+", 1).alias("seq_id"), F.regexp_replace(F.regexp_extract("value", r"^\S+\s+([A-Za-z*.\- ]+)", 1), " ", "").alias("chunk"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "chunk"))), lambda s: s["chunk"])
    return cut.groupBy("file", "seq_id").agg(F.array_join(ordered, "").alias("aligned")).select("seq_id", "aligned")


def _phylip(lines: DataFrame) -> DataFrame:
    """Relaxed PHYLIP from text lines numbered without blank ones: ids end at the first blank."""
    sizes = r"^\s*(\d+)\s+(\d+)\s*$"
    head = lines.where("line = 0").select("file", *[F.regexp_extract("value", sizes, k).cast("long").alias(c) for k, c in ((1, "_rows"), (2, "_columns"))])
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    rest = bare(F.regexp_extract("value", r"^\s*\S+\s+(.*)$", 1))
    text = lines.where("line > 0").select("file", (F.col("line") - 1).alias("_i"), "value", F.regexp_extract("value", r"^\s*(\S+)", 1).alias("_name"), rest.alias("_rest"), bare(F.col("value")).alias("_all"))
    # a first row without all columns is followed by a line without an id only where rows stand one after another
    shape = text.groupBy("file").agg(
        F.count(F.lit(1)).alias("_lines"), F.max(F.when(F.col("_i") == 0, F.length("_rest"))).alias("_wide"),
        F.max(F.when(F.col("_i") == 1, F.col("value").rlike(r"^\s") | (F.col("_rest") == ""))).alias("_unnamed"),
    ).join(head, "file")
    sequential = (F.col("_wide") < F.col("_columns")) & F.coalesce("_unnamed", F.lit(False)) & (F.col("_rows") > 0)
    shape = shape.select("file", "_rows", sequential.alias("_seq"), F.floor(F.col("_lines") / F.greatest("_rows", F.lit(1))).alias("_each"))
    placed = text.join(F.broadcast(shape), "file")  # one row per file
    row = F.when(F.col("_seq"), F.floor(F.col("_i") / F.col("_each"))).otherwise(F.col("_i") % F.col("_rows"))
    named = F.when(F.col("_seq"), F.col("_i") % F.col("_each") == 0).otherwise(F.col("_i") < F.col("_rows"))
    cut = placed.select("file", row.alias("_row"), "_i", F.when(named, F.col("_name")).alias("_id"), F.when(named, F.col("_rest")).otherwise(F.col("_all")).alias("chunk"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "chunk"))), lambda s: s["chunk"])
    return cut.groupBy("file", "_row").agg(F.max("_id").alias("seq_id"), F.array_join(ordered, "").alias("aligned")).select("seq_id", "aligned")


def fasta_text(with_description: bool = True) -> Column:
    head = F.concat_ws(" ", F.col("seq_id").cast("string"), "description") if with_description else F.col("seq_id").cast("string")
    return F.concat(F.lit(">"), head, F.lit("\n"), "seq")


def write_fasta(df: DataFrame, path: str) -> int:
    """Write records as FASTA parts; returns how many were written."""
    seen = Observation("fasta")
    df.observe(seen, F.count(F.lit(1)).alias("n")).select(fasta_text("description" in df.columns).alias("value")).write.mode("errorifexists").text(path)
    return seen.get["n"]


def write_fastq(df: DataFrame, path: str) -> int:
    """Write FASTQ; a missing quality becomes a placeholder of equal length."""
    qual = F.coalesce(F.col("qual"), F.repeat(F.lit("I"), F.length("seq"))) if "qual" in df.columns else F.repeat(F.lit("I"), F.length("seq"))
    seen = Observation("fastq")
    text = F.concat(F.lit("@"), F.col("seq_id").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), qual)
    df.observe(seen, F.count(F.lit(1)).alias("n")).select(text.alias("value")).write.mode("errorifexists").text(path)
    return seen.get["n"]


def convert_format(spark: SparkSession, source: str, target: str, source_format: str, target_format: str, keep: Column | None = None) -> int:
    """Read, filter and write in one pass: fasta, fastq or genbank to fasta or fastq."""
    readers = {"fasta": read_fasta, "fastq": read_fastq, "genbank": read_genbank}
    writers = {"fasta": write_fasta, "fastq": write_fastq}
    rows = readers[source_format](spark, source)
    return writers[target_format](rows.where(keep) if keep is not None else rows, target)


def wanted_only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose id is listed."""
    return df.join(ids.select("seq_id").distinct(), "seq_id", "left_semi")


def first_records(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records by id."""
    return row_positions(df, [F.asc("seq_id")]).where(F.col("position") <= n).drop("position")

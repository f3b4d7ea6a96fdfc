"""Coordinate conversions; canonical form is zero-based half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coordinate base of common formats.
ZERO_BASED = ("bed", "psl", "bedgraph", "bam")
ONE_BASED = ("gff", "gff3", "gtf", "genbank", "ensembl", "sam", "vcf", "wig", "hgvs")


def _base(fmt: Column | str) -> Column:
    col = F.lit(fmt) if isinstance(fmt, str) else fmt
    return F.when(F.lower(col).isin(*ZERO_BASED), 0).when(F.lower(col).isin(*ONE_BASED), 1)


def to_zero_start(start: Column, fmt: Column | str) -> Column:
    """Start of the half-open form; the end needs no change in either base."""
    return start - _base(fmt)


def to_one_start(start0: Column) -> Column:
    return start0 + 1


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def plain_chromosome(chrom: Column, prefix: bool = True) -> Column:
    """One spelling per chromosome: prefix dropped or added, ``M`` for ``MT``."""
    bare = F.regexp_replace(chrom, "(?i)^chr", "")
    bare = F.when(F.upper(bare).isin("M", "MT"), "M").otherwise(bare)
    return F.concat(F.lit("chr"), bare) if prefix else bare


def protein_place(cds_pos: Column) -> tuple[Column, Column]:
    """Residue number and codon frame (0-2) of a one-based coding position."""
    return F.floor((cds_pos - 1) / 3) + 1, F.pmod(cds_pos - 1, F.lit(3))

"""Column functions on sequence text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandframe.functions import tables as T
from strandframe.plans import letters

ColumnOrName = str | Column


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def letter_count(seq: ColumnOrName, letters: str) -> Column:
    """How many letters of ``seq`` are among ``letters`` (as written)."""
    s = _c(seq)
    return F.length(s) - F.length(F.translate(s, letters, ""))


def sequence_kind(seq: ColumnOrName) -> Column:
    """rna: has U and no T; protein: has a letter outside the nucleic alphabet; else dna."""
    up = F.upper(_c(seq))
    return (
        F.when(up.contains("U") & ~up.contains("T"), "rna")
        .when(up.rlike("[^ACGTRYSWKMBDHVNXU.\\-]"), "protein")
        .otherwise("dna")
    )


def gc_fraction(seq: ColumnOrName) -> Column:
    """(G+C+S) / (A+C+G+T+U+S+W); other letters are left out; 0 when none remain."""
    gc = letter_count(seq, "GCSgcs")
    known = letter_count(seq, "ACGTUSWacgtusw")
    return F.when(known > 0, gc / known).otherwise(F.lit(0.0))


def gc_percent(seq: ColumnOrName, digits: int = 2) -> Column:
    return F.round(gc_fraction(seq) * 100, digits)


def complement(seq: ColumnOrName, rna: bool = False) -> Column:
    """IUPAC complement, case kept; ``A`` pairs with ``T`` unless ``rna``."""
    out = F.translate(_c(seq), T.COMPLEMENT_FROM, T.COMPLEMENT_TO)
    return F.translate(out, "Tt", "Uu") if rna else out


def reverse_complement(seq: ColumnOrName, rna: bool = False) -> Column:
    return F.reverse(complement(seq, rna))


def transcribe(seq: ColumnOrName) -> Column:
    return F.translate(_c(seq), "Tt", "Uu")


def back_transcribe(seq: ColumnOrName) -> Column:
    return F.translate(_c(seq), "Uu", "Tt")


def codons(seq: ColumnOrName) -> Column:
    """Whole codons in order; a partial last codon is dropped."""
    return F.regexp_extract_all(_c(seq), F.lit("(?s)..."), F.lit(0))


def amino_array(seq: Column, table: int = 1) -> Column:
    """Residue letter of every whole codon of an upper-case text (T, not U).

    Letters become the hexadecimal digit of their base set, so a codon is a
    three-digit place in the table of all base-set triples.
    """
    lookup = F.split(F.lit(T.degenerate_residues(table)), "")
    digits = F.translate(F.regexp_replace(seq, f"[^{T.IUPAC_ORDER}]", "0"), T.IUPAC_ORDER, "123456789ABCDEF")
    plain = F.transform(codons(digits), lambda c: F.get(lookup, F.conv(c, 16, 10).cast("int")))
    # only a text with gaps has to tell a pure gap codon from an unknown one
    gapped = F.zip_with(codons(seq), plain, lambda c, aa: F.when(c == "---", "-").otherwise(aa))
    return F.when(seq.contains("---"), gapped).otherwise(plain)


def translate(seq: ColumnOrName, table: int = 1, to_stop: bool = False) -> Column:
    """Protein text; ``*`` for stops, ``X`` where a codon is not determined."""
    protein = F.array_join(amino_array(F.translate(F.upper(_c(seq)), "U", "T"), table), "")
    return F.split_part(protein, F.lit("*"), F.lit(1)) if to_stop else protein


def known_bases(seq: ColumnOrName) -> Column:
    """Upper case with X and gap letters turned into N, for frame translation."""
    return F.translate(F.upper(_c(seq)), "X-.", "NNN")


def _mass(seq: Column, masses: dict[str, float]) -> Column:
    # whole units of 1e-4 dalton, so the two-digit rounding is exact
    total = F.lit(0).cast("long")
    for letter, mass in masses.items():
        total = total + letter_count(seq, letter).cast("long") * F.lit(round(mass * 10000))
    known = letter_count(seq, "".join(masses))
    n = F.length(seq)
    units = total - (n - 1).cast("long") * F.lit(round(T.WATER_MASS * 10000))
    return F.when((n > 0) & (known == n), F.floor((units + 50) / 100) / 100)


def mass_of_counts(counts: ColumnOrName, length: Column, masses: dict[str, float]) -> Column:
    """As :func:`protein_mass`, from the :func:`letter_counts` of an upper-case text."""
    count = lambda x: F.get(counts, F.lit(ord(x) - 65)).cast("long")
    total = sum((count(x) * F.lit(round(m * 10000)) for x, m in masses.items()), F.lit(0).cast("long"))
    known = sum((count(x) for x in masses), F.lit(0).cast("long"))
    units = total - (length - 1).cast("long") * F.lit(round(T.WATER_MASS * 10000))
    return F.when((length > 0) & (known == length), F.floor((units + 50) / 100) / 100)


def protein_mass(seq: ColumnOrName) -> Column:
    """Average mass in dalton, null when a residue is unknown."""
    return _mass(F.upper(_c(seq)), T.RESIDUE_MASS)


def nucleic_mass(seq: ColumnOrName, rna: bool = False) -> Column:
    return _mass(F.upper(_c(seq)), T.RNA_MASS if rna else T.DNA_MASS)


def wallace_temperature(seq: ColumnOrName) -> Column:
    """2(A+T) + 4(G+C), after Thein and Wallace 1986."""
    up = F.upper(_c(seq))
    return (letter_count(up, "ATW") * 2 + letter_count(up, "GCS") * 4).cast("double")


def letter_counts(seq: ColumnOrName) -> Column:
    """Counts of the letters A to Z (as written) as an array of 26, all in one pass over the text."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        found = [None if t is None else np.bincount(letters.one_byte(t), minlength=128)[65:91].astype(np.int32) for t in _texts(texts)]
        return pd.Series(found, dtype=object)

    return run(_c(seq))


def _texts(given: pd.Series) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in given.tolist()]


def pair_sums(seq: ColumnOrName) -> Column:
    """Struct of summed neighbour enthalpy and entropy over adjacent pairs; pairs with a letter outside A, C, G, T have none."""
    tenths = np.zeros((2, 25), np.int64)
    code = np.full(256, 4, np.int64)
    code[[ord(x) for x in "ACGT"]] = range(4)
    for (x, y), both in T.NEIGHBOUR_ENERGY.items():
        tenths[:, 5 * "ACGT".index(x) + "ACGT".index(y)] = [round(v * 10) for v in both]

    @F.pandas_udf("dh double, ds double")
    def run(texts: pd.Series) -> pd.DataFrame:
        sums = np.zeros((len(texts), 2))
        for k, t in enumerate(_texts(texts)):
            if t:
                at = code[letters.one_byte(t)]
                sums[k] = tenths @ np.bincount(5 * at[:-1] + at[1:], minlength=25) / 10
        return pd.DataFrame({"dh": sums[:, 0], "ds": sums[:, 1]})

    return run(_c(seq))


def frame_proteins(seq: ColumnOrName, table: int = 1) -> Column:
    """Proteins of the three frames of a text without gaps, as an array; null for null."""
    residues = np.frombuffer(T.degenerate_residues(table).encode(), np.uint8)
    digit = np.zeros(256, np.int64)
    for k, x in enumerate(T.IUPAC_ORDER):
        digit[[ord(x), ord(x.lower())]] = k + 1
    digit[[ord(x) for x in "Uu"]] = digit[ord("T")]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        found = []
        for t in _texts(texts):
            if t is not None:
                d = digit[letters.one_byte(t)]
                read = residues[256 * d[:-2] + 16 * d[1:-1] + d[2:]].tobytes().decode() if len(d) > 2 else ""
                t = [read[k::3] for k in range(3)]
            found.append(t)
        return pd.Series(found, dtype=object)

    return run(_c(seq))


def melting_from_sums(dh: Column, ds: Column, first: Column, last: Column, length: Column,
                      sodium_mm: float = 50.0, strand_nm: float = 25.0) -> Column:
    """Two-state melting temperature from summed neighbour energies.

    Duplex of two strands at ``strand_nm`` each, SantaLucia 1998 entropy salt
    correction 0.368 (n-1) ln[Na+].
    """
    def ends(which: int) -> Column:
        at, gc = T.END_ENERGY_AT[which], T.END_ENERGY_GC[which]
        one = lambda ch: F.when(ch.isin("A", "T"), F.lit(at)).when(ch.isin("G", "C"), F.lit(gc)).otherwise(F.lit(0.0))
        return one(first) + one(last)

    enthalpy = dh + ends(0)
    entropy = ds + ends(1) + F.lit(0.368) * (length - 1) * F.log(F.lit(sodium_mm * 1e-3))
    dissociation = F.log(F.lit((strand_nm - strand_nm / 2.0) * 1e-9))
    return F.lit(1000.0) * enthalpy / (entropy + F.lit(1.987) * dissociation) - F.lit(273.15)


def neighbour_temperature(seq: ColumnOrName, sodium_mm: float = 50.0, strand_nm: float = 25.0) -> Column:
    up = F.regexp_replace(F.upper(_c(seq)), "[^ACGT]", "")
    sums = pair_sums(up)
    return F.when(
        F.length(up) > 1,
        melting_from_sums(sums["dh"], sums["ds"], F.left(up, F.lit(1)), F.right(up, F.lit(1)), F.length(up), sodium_mm, strand_nm),
    )


def to_three_letter(seq: ColumnOrName) -> Column:
    """One letter residues to three letter codes, ``Xaa`` where unknown."""
    names = np.array([T.THREE_LETTER.get(chr(k), "Xaa").encode() for k in range(256)], "S3")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else names[letters.one_byte(t)].tobytes().decode() for t in _texts(texts)], dtype=object)

    return run(_c(seq))


def to_one_letter(seq: ColumnOrName) -> Column:
    """Three letter codes back to one letter, ``X`` where unknown."""
    one = {v: k for k, v in T.THREE_LETTER.items()}

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}
        found = []
        for t in _texts(texts):
            if t is not None:
                words = [t[k : k + 3] for k in range(0, len(t) - len(t) % 3, 3)]
                for w in set(words) - seen.keys():
                    seen[w] = one.get(w[:1].upper() + w[1:].lower(), "X")
                t = "".join([seen[w] for w in words])
            found.append(t)
        return pd.Series(found, dtype=object)

    return run(_c(seq))


def overlapping_positions(seq: ColumnOrName, pattern: str) -> Column:
    """Zero-based starts of every, also overlapping, match of an IUPAC pattern."""
    up = F.upper(_c(seq))
    n, m = F.length(up), len(pattern)
    flags = F.regexp_extract_all(up, F.lit(f"(?s)(?=(.{{{m}}}))"), F.lit(1))
    rx = f"^{T.iupac_pattern(pattern)}$"
    marked = F.transform(flags, lambda w, i: F.when(w.rlike(rx), i))
    return F.when(n >= m, F.filter(marked, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))

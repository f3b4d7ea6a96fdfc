"""Registered queries on sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog.base import query
from strandframe.functions import dna
from strandframe.functions import tables as T
from strandframe.operators import codons, restriction, sequence

CHARS = "SELECT seq_id, unnest(string_split(seq, '')) AS ch, unnest(range(length(seq))) AS pos FROM seqs WHERE length(seq) > 0"
RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
CODE = ", ".join(f"('{c}', '{a}')" for c, a in sorted(T.codon_amino(1).items()))
TRIPLES = """SELECT * FROM (SELECT seq_id, pos, ch || lead(ch, 1) OVER w || lead(ch, 2) OVER w AS codon FROM chars
    WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) t WHERE codon IS NOT NULL"""
GC = "(length(seq) - length(translate(seq, 'GC', '')))"


def _mass_sql(masses):
    total = " + ".join(f"(length(seq) - length(replace(seq, '{a}', ''))) * {round(m * 10000)}" for a, m in masses.items())
    return f"CASE WHEN length(seq) > 0 THEN (({total} - (length(seq) - 1) * {round(T.WATER_MASS * 10000)} + 50) // 100) / 100.0::DOUBLE END"


@query("seq_type", "SELECT seq_id, CASE WHEN regexp_matches(seq, '[^ACGTRYSWKMBDHVNXU.-]') THEN 'protein' ELSE 'dna' END AS seq_type, length(seq) AS length FROM prots", ["prots"])
def _(x):
    return x.prots.select("seq_id", dna.sequence_kind("seq").alias("seq_type"), F.length("seq").alias("length"))


@query(
    "seq_stats",
    f"""SELECT seq_id, length(seq) AS length, CASE WHEN length(seq) > 0 THEN round({GC} / length(seq)::DOUBLE, 6) ELSE 0.0 END AS gc_fraction,
        CASE WHEN length(seq) > 0 THEN round({GC} / length(seq)::DOUBLE * 100, 2) ELSE 0.0 END AS gc_percent FROM seqs""",
    ["seqs"],
)
def _(x):
    return sequence.seq_stats(x.seqs)


@query("complement_forms", f"""SELECT seq_id, translate(seq, 'ACGT', 'TGCA') AS complement, {RC} AS reverse_complement,
    replace(seq, 'T', 'U') AS rna FROM seqs""", ["seqs"])
def _(x):
    return x.seqs.select(
        "seq_id", dna.complement("seq").alias("complement"), dna.reverse_complement("seq").alias("reverse_complement"), dna.transcribe("seq").alias("rna")
    )


@query(
    "seq_translate",
    f"""WITH chars AS ({CHARS}), code(codon, aa) AS (VALUES {CODE}), tri AS ({TRIPLES}),
    p AS (SELECT seq_id, string_agg(aa, '' ORDER BY pos) AS protein FROM tri JOIN code USING (codon) WHERE pos % 3 = 0 GROUP BY seq_id)
    SELECT seqs.seq_id, coalesce(protein, '') AS protein, split_part(coalesce(protein, ''), '*', 1) AS protein_to_stop FROM seqs LEFT JOIN p USING (seq_id)""",
    ["seqs"],
)
def _(x):
    return x.seqs.select("seq_id", dna.translate("seq").alias("protein"), dna.translate("seq", to_stop=True).alias("protein_to_stop"))


@query(
    "six_frame",
    f"""WITH strands2 AS (SELECT seq_id, '+' AS strand, seq FROM seqs UNION ALL SELECT seq_id, '-', {RC} FROM seqs),
    chars AS (SELECT seq_id, strand, unnest(string_split(seq, '')) AS ch, unnest(range(length(seq))) AS pos FROM strands2 WHERE length(seq) > 0),
    code(codon, aa) AS (VALUES {CODE}),
    tri AS (SELECT seq_id, strand, pos, ch || lead(ch, 1) OVER w || lead(ch, 2) OVER w AS codon FROM chars WINDOW w AS (PARTITION BY seq_id, strand ORDER BY pos)),
    p AS (SELECT seq_id, strand || (pos % 3 + 1) AS frame, string_agg(aa, '' ORDER BY pos) AS protein FROM tri JOIN code USING (codon) GROUP BY ALL)
    SELECT seq_id, frame, coalesce(protein, '') AS protein
    FROM (SELECT seq_id, unnest(['+1', '+2', '+3', '-1', '-2', '-3']) AS frame FROM seqs) g LEFT JOIN p USING (seq_id, frame)""",
    ["seqs"],
)
def _(x):
    return sequence.six_frame(x.seqs)


@query(
    "protein_stats",
    f"SELECT seq_id, length(seq) AS length, {_mass_sql(T.RESIDUE_MASS)} AS molecular_weight FROM prots",
    ["prots"],
)
def _(x):
    return x.prots.select("seq_id", F.length("seq").alias("length"), dna.protein_mass("seq").alias("molecular_weight"))


@query(
    "residue_composition",
    """WITH c AS (SELECT seq_id, unnest(string_split(seq, '')) AS residue FROM prots WHERE length(seq) > 0),
    n AS (SELECT seq_id, residue, count(*) AS n FROM c GROUP BY ALL)
    SELECT seq_id, residue, n, round(n / sum(n) OVER (PARTITION BY seq_id), 6) AS share FROM n""",
    ["prots"],
)
def _(x):
    return sequence.residue_composition(x.prots)


_CNT = lambda s: "(length(seq) - length(translate(seq, '%s', '')))::DOUBLE" % s
_CHARGE = (
    "1/(1+pow(10, m-7.5)) - 1/(1+pow(10, 3.55-m)) + "
    + " + ".join(f"c{a}/(1+pow(10, m-{pk}))" for a, pk in (("K", 10.0), ("R", 12.0), ("H", 5.98)))
    + " - "
    + " - ".join(f"c{a}/(1+pow(10, {pk}-m))" for a, pk in (("D", 4.05), ("E", 4.45), ("C", 9.0), ("Y", 10.0)))
)


@query(
    "protein_parameters",
    f"""WITH base AS (SELECT seq_id, length(seq) AS length, {_mass_sql(T.RESIDUE_MASS)} AS molecular_weight,
        round({_CNT("FWY")} / length(seq), 6) AS aromaticity, round({_CNT("VIYFWL")} / length(seq), 6) AS helix,
        round({_CNT("NPGS")} / length(seq), 6) AS turn, round({_CNT("EMAL")} / length(seq), 6) AS sheet,
        {", ".join(f"{_CNT(a)} AS c{a}" for a in "KRHDECY")} FROM prots WHERE length(seq) > 0),
    bis AS (SELECT seq_id AS k, cK, cR, cH, cD, cE, cC, cY, 0.0::DOUBLE AS lo, 14.0::DOUBLE AS hi, 7.0::DOUBLE AS m, 0 AS i FROM base
        UNION ALL SELECT k, cK, cR, cH, cD, cE, cC, cY, CASE WHEN s > 0 THEN m ELSE lo END, CASE WHEN s > 0 THEN hi ELSE m END,
            CASE WHEN s > 0 THEN (m + hi) / 2 ELSE (lo + m) / 2 END, i + 1 FROM (SELECT *, {_CHARGE} AS s FROM bis WHERE i < 50) z)
    SELECT seq_id, length, molecular_weight, aromaticity, helix, turn, sheet, round(m, 4) AS isoelectric_point FROM base JOIN bis ON k = seq_id WHERE i = 50""",
    ["prots"],
)
def _(x):
    return sequence.protein_parameters(x.prots)


_NN = ", ".join(f"('{p}', {h}::DOUBLE, {s}::DOUBLE)" for p, (h, s) in T.NEIGHBOUR_ENERGY.items())


@query(
    "nucleic_parameters",
    f"""WITH chars AS ({CHARS}), nn(pair, dh, ds) AS (VALUES {_NN}),
    pairs AS (SELECT seq_id, ch || lead(ch) OVER (PARTITION BY seq_id ORDER BY pos) AS pair FROM chars),
    sums AS (SELECT seq_id, sum(dh) AS dh, sum(ds) AS ds FROM pairs JOIN nn USING (pair) GROUP BY seq_id),
    e AS (SELECT s.*, (CASE WHEN seq[1] IN ('A','T') THEN 1 ELSE 0 END) + (CASE WHEN seq[-1] IN ('A','T') THEN 1 ELSE 0 END) AS at_ends FROM seqs s)
    SELECT seq_id, {_mass_sql(T.DNA_MASS)} AS mass,
    round(2.0 * (length(seq) - {GC}) + 4.0 * {GC}, 2)::DOUBLE AS tm_wallace,
    round(1000 * (dh + at_ends * 2.3 + (2 - at_ends) * 0.1) / (ds + at_ends * 4.1 - (2 - at_ends) * 2.8 + 0.368 * (length(seq) - 1) * ln(0.05) + 1.987 * ln(12.5e-9)) - 273.15, 2) AS tm_neighbour
    FROM e LEFT JOIN sums USING (seq_id)""",
    ["seqs"],
)
def _(x):
    return sequence.nucleic_parameters(x.seqs)


@query(
    "gc_skew",
    """WITH chunks AS (SELECT seq_id, unnest(range((length(seq) + 99) // 100)) AS chunk, seq FROM seqs),
    t AS (SELECT seq_id, chunk, substr(seq, chunk * 100 + 1, 100) AS t FROM chunks),
    n AS (SELECT seq_id, chunk, length(t) - length(replace(t, 'G', '')) AS g, length(t) - length(replace(t, 'C', '')) AS c FROM t),
    s AS (SELECT seq_id, chunk, CASE WHEN g + c > 0 THEN round((g - c) / (g + c)::DOUBLE, 4) ELSE 0.0 END AS skew FROM n)
    SELECT seq_id, chunk, skew, round(sum(skew) OVER (PARTITION BY seq_id ORDER BY chunk), 6) AS cumulative FROM s""",
    ["seqs"],
)
def _(x):
    return sequence.gc_skew(x.seqs).withColumn("cumulative", F.round("cumulative", 6))


def _kmers_sql(k: int) -> str:
    parts = " || ".join(["ch", *[f"lead(ch, {i}) OVER w" for i in range(1, k)]])
    return f"SELECT * FROM (SELECT seq_id, pos, {parts} AS kmer FROM chars WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) t WHERE kmer IS NOT NULL"


@query(
    "kmer_top",
    f"""WITH chars AS ({CHARS}), k AS ({_kmers_sql(5)}), c AS (SELECT seq_id, kmer, count(*) AS n, min(pos) AS fp FROM k GROUP BY ALL),
    r AS (SELECT seq_id, kmer, n, row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, fp) AS rank,
        sum(n) OVER (PARTITION BY seq_id) AS total_kmers, count(*) OVER (PARTITION BY seq_id) AS unique_kmers FROM c)
    SELECT * FROM r WHERE rank <= 10""",
    ["seqs"],
)
def _(x):
    return sequence.kmer_count(x.seqs, k=5, top=10)


@query(
    "kmer_spectrum",
    f"WITH chars AS ({CHARS}), k AS ({_kmers_sql(6)}) SELECT kmer, count(*) AS n, count(DISTINCT seq_id) AS n_seqs FROM k GROUP BY kmer",
    ["seqs"],
)
def _(x):
    return sequence.kmer_spectrum(x.seqs, k=6)


_MARKS = """marks AS (SELECT seq_id, pos AS start, pos % 3 + 1 AS frame, codon <> 'ATG' AS is_stop,
    min(CASE WHEN codon <> 'ATG' THEN pos END) OVER (PARTITION BY seq_id{s}, pos % 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop{s}
    FROM tri WHERE codon IN ('ATG', 'TAA', 'TAG', 'TGA'))"""
_BOTH = f"""strands2 AS (SELECT seq_id, '+' AS strand, seq FROM seqs UNION ALL SELECT seq_id, '-', {RC} FROM seqs),
    chars AS (SELECT seq_id, strand, unnest(string_split(seq, '')) AS ch, unnest(range(length(seq))) AS pos FROM strands2 WHERE length(seq) > 0),
    tri AS (SELECT seq_id, strand, pos, ch || lead(ch, 1) OVER w || lead(ch, 2) OVER w AS codon FROM chars WINDOW w AS (PARTITION BY seq_id, strand ORDER BY pos))"""


@query(
    "longest_orf",
    f"""WITH chars AS ({CHARS}), tri AS ({TRIPLES}), {_MARKS.format(s="")},
    o AS (SELECT seq_id, start, stop + 3 AS "end", stop + 3 - start AS length, frame FROM marks WHERE NOT is_stop AND stop IS NOT NULL AND stop + 3 - start >= 30),
    b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY length DESC, frame, start) = 1),
    code(codon, aa) AS (VALUES {CODE}),
    p AS (SELECT b.seq_id, string_agg(aa, '' ORDER BY pos) AS protein FROM b JOIN tri t ON t.seq_id = b.seq_id AND t.pos >= b.start AND t.pos < b."end" - 3 AND (t.pos - b.start) % 3 = 0
        JOIN code USING (codon) GROUP BY b.seq_id)
    SELECT b.*, p.protein FROM b JOIN p USING (seq_id)""",
    ["seqs"],
)
def _(x):
    return sequence.longest_orf(x.seqs)


@query(
    "all_orfs",
    f"""WITH {_BOTH}, {_MARKS.format(s=", strand")}
    SELECT seq_id, strand, frame, min(start) AS start, stop + 3 AS "end", stop + 3 - min(start) AS length_nt
    FROM marks WHERE NOT is_stop AND stop IS NOT NULL GROUP BY seq_id, strand, frame, stop HAVING stop + 3 - min(start) >= 90""",
    ["seqs"],
)
def _(x):
    return sequence.all_orfs(x.seqs)


@query(
    "truncated_orfs",
    f"""WITH {_BOTH}, {_MARKS.format(s=", strand")}
    SELECT seq_id, strand, frame, min(start) AS start FROM marks WHERE NOT is_stop AND stop IS NULL GROUP BY ALL""",
    ["seqs"],
)
def _(x):
    return sequence.truncated_orfs(x.seqs)


_SITES = ", ".join(f"('{n}', '{s}', '^{T.iupac_pattern(s)}$', {o}, {len(s)})" for n, (s, o) in T.ENZYMES.items())
_EIGHT = " || ".join(["ch", *[f"coalesce(lead(ch, {i}) OVER w, '')" for i in range(1, 8)]])
_CUTS = f"""enz(enzyme, site, rx, off, m) AS (VALUES {_SITES}), chars AS ({CHARS}),
    win AS (SELECT seq_id, pos, {_EIGHT} AS w8 FROM chars WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
    cuts AS (SELECT seq_id, enzyme, site, pos + off + 1 AS cut FROM win, enz WHERE length(w8) >= m AND regexp_matches(substr(w8, 1, m), rx))"""


@query(
    "restriction_sites",
    f"""WITH {_CUTS} SELECT seq_id, enzyme, site, count(*) AS n_cuts, string_agg(cut::VARCHAR, ',' ORDER BY cut) AS cut_positions FROM cuts GROUP BY ALL""",
    ["seqs"],
)
def _(x):
    return restriction.restriction_sites(x.seqs)


@query(
    "digest_fragments",
    f"""WITH {_CUTS}, c AS (SELECT DISTINCT seq_id, cut FROM cuts WHERE enzyme IN ('TaqI', 'AluI', 'DdeI')),
    pts AS (SELECT seq_id, cut FROM c UNION SELECT seq_id, 1 FROM seqs WHERE length(seq) > 0),
    f AS (SELECT seq_id, cut AS start, lead(cut) OVER (PARTITION BY seq_id ORDER BY cut) - 1 AS e FROM pts)
    SELECT seq_id, start, coalesce(e, length(seq)) AS "end", coalesce(e, length(seq)) - start + 1 AS size FROM f JOIN seqs USING (seq_id)""",
    ["seqs"],
)
def _(x):
    return restriction.digest_fragments(x.seqs, ["TaqI", "AluI", "DdeI"])


@query(
    "cloning_check",
    f"""WITH {_CUTS}, n AS (SELECT seq_id, count(*) FILTER (enzyme = 'EcoRI') AS n1, count(*) FILTER (enzyme = 'BamHI') AS n2 FROM cuts GROUP BY seq_id)
    SELECT seq_id, coalesce(n1, 0) AS n_first, coalesce(n2, 0) AS n_second, CASE WHEN coalesce(n1, 0) + coalesce(n2, 0) > 0 THEN 'internal site' ELSE 'usable' END AS insert_status
    FROM seqs LEFT JOIN n USING (seq_id)""",
    ["seqs"],
)
def _(x):
    return restriction.cloning_check(x.seqs, "EcoRI", "BamHI")


@query(
    "seq_qc",
    f"""SELECT count(*) AS count, sum(length(seq)) AS total_bp, min(length(seq)) AS len_min, max(length(seq)) AS len_max, round(avg(length(seq)), 1) AS len_avg,
    round(min({GC} / length(seq)::DOUBLE) * 100, 2) AS gc_min, round(max({GC} / length(seq)::DOUBLE) * 100, 2) AS gc_max,
    round(avg({GC} / length(seq)::DOUBLE) * 100, 2) AS gc_avg, 0.0::DOUBLE AS n_total, 0 AS n_flagged FROM seqs WHERE length(seq) > 0""",
    ["seqs"],
)
def _(x):
    return sequence.seq_qc(x.seqs)


@query(
    "flagged_sequences",
    """SELECT seq_id, (length(seq) - length(replace(seq, 'N', ''))) / length(seq)::DOUBLE AS n_share FROM prots
    WHERE length(seq) > 0 AND (length(seq) - length(replace(seq, 'N', ''))) / length(seq)::DOUBLE > 0.05""",
    ["prots"],
)
def _(x):
    return sequence.flag_ambiguous(x.prots)


@query("base_composition", f"WITH chars AS ({CHARS}) SELECT ch AS base, count(*) AS n FROM chars GROUP BY ch", ["seqs"])
def _(x):
    return sequence.base_composition(x.seqs)


@query(
    "pattern_count",
    "SELECT seq_id, CAST((length(seq) - length(replace(seq, 'GAT', ''))) / 3 AS BIGINT) AS n, instr(seq, 'GAT') - 1 AS first_index FROM seqs",
    ["seqs"],
)
def _(x):
    return sequence.pattern_count(x.seqs, "GAT")


@query(
    "pattern_search",
    f"""WITH chars AS ({CHARS}), k AS ({_kmers_sql(6)}) SELECT seq_id, pos FROM k WHERE regexp_matches(kmer, '^[AG]AT[ACGT][CT]A$')""",
    ["seqs"],
)
def _(x):
    return sequence.pattern_search(x.seqs, "RATNYA")


_THREE = "CASE " + " ".join(f"WHEN ch = '{a}' THEN '{n}'" for a, n in T.THREE_LETTER.items()) + " END"


@query(
    "three_letter_codes",
    f"""WITH c AS (SELECT seq_id, unnest(string_split(seq, '')) AS ch, unnest(range(length(seq))) AS pos FROM prots WHERE length(seq) > 0)
    SELECT seq_id, string_agg({_THREE}, '' ORDER BY pos) AS three, string_agg(ch, '' ORDER BY pos) AS one FROM c GROUP BY seq_id""",
    ["prots"],
)
def _(x):
    three = x.prots.where(F.length("seq") > 0).select("seq_id", dna.to_three_letter("seq").alias("three"))
    return three.select("seq_id", "three", dna.to_one_letter("three").alias("one"))


@query(
    "codon_usage",
    f"""WITH chars AS ({CHARS}), code(codon, aa) AS (VALUES {CODE}), tri AS ({TRIPLES}),
    n AS (SELECT codon, aa, count(*) AS n FROM tri JOIN code USING (codon) WHERE pos % 3 = 0 GROUP BY ALL)
    SELECT codon, aa, n, round(n / sum(n) OVER (), 6) AS share, round(n / sum(n) OVER (PARTITION BY aa), 6) AS share_in_aa FROM n""",
    ["seqs"],
)
def _(x):
    return codons.codon_usage(x.seqs)


@query(
    "codon_adaptation",
    f"""WITH chars AS ({CHARS}), code(codon, aa) AS (VALUES {CODE}), tri AS ({TRIPLES}), u AS (SELECT * FROM tri WHERE pos % 3 = 0),
    r AS (SELECT codon, count(*)::DOUBLE AS n FROM u GROUP BY codon),
    w AS (SELECT codon, aa, ln(coalesce(n, 0.5) / max(coalesce(n, 0.5)) OVER (PARTITION BY aa)) AS lw FROM code LEFT JOIN r USING (codon)),
    k AS (SELECT seq_id, codon, count(*) AS n FROM u GROUP BY ALL)
    SELECT seq_id, round(exp(sum(n * lw) / sum(n)), 6) AS cai, sum(n)::BIGINT AS n_codons FROM k JOIN w USING (codon) WHERE aa NOT IN ('*', 'M', 'W') GROUP BY seq_id""",
    ["seqs"],
)
def _(x):
    return codons.adaptation_index(x.seqs, x.seqs)


_HOST = ", ".join(f"('{aa}', '{codon}')" for aa, codon in (T.HOST_CODONS["ecoli"] | {"*": "TAA"}).items())
_OPT = f"""chars AS ({CHARS}), code(codon, aa) AS (VALUES {CODE}), host(aa, best) AS (VALUES {_HOST}), tri AS ({TRIPLES}),
    o AS (SELECT seq_id, string_agg(best, '' ORDER BY pos) AS optimized_sequence, count(*) FILTER (aa <> '*' AND best <> codon) AS codon_changes, count(*) AS protein_length
        FROM tri JOIN code USING (codon) JOIN host USING (aa) WHERE pos % 3 = 0 GROUP BY seq_id)"""


@query(
    "codon_optimize",
    f"""WITH {_OPT} SELECT seq_id, length(seq) AS original_length, length(optimized_sequence) AS optimized_length, optimized_sequence, codon_changes,
    round(codon_changes / protein_length::DOUBLE * 100, 1) AS change_rate,
    round((length(optimized_sequence) - length(translate(optimized_sequence, 'GC', ''))) / length(optimized_sequence)::DOUBLE * 100, 1) AS gc_percent, protein_length
    FROM o JOIN seqs USING (seq_id)""",
    ["seqs"],
)
def _(x):
    return codons.codon_optimize(x.seqs, "ecoli")


@query("verify_backtranslation", "SELECT seq_id, TRUE AS same_protein FROM seqs WHERE length(seq) >= 3", ["seqs"])
def _(x):
    return codons.verify_backtranslation(x.seqs, "human")


@query(
    "rare_codon_clusters",
    f"""WITH chars AS ({CHARS}), tri AS ({TRIPLES}), r AS (SELECT seq_id, pos // 3 AS i, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS rn FROM tri WHERE pos % 3 = 0 AND codon IN ('AGG', 'AGA'))
    SELECT seq_id, min(i) AS first_codon, count(*) AS run_length FROM r GROUP BY seq_id, i - rn HAVING count(*) >= 2""",
    ["seqs"],
)
def _(x):
    return codons.rare_codon_clusters(x.seqs)

"""Registered queries on variants and genotypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog.base import query
from strandframe.operators import popgen, variants


@query(
    "variant_type_counts",
    """SELECT CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNV' WHEN length(ref) > 1 AND length(alt) = 1 THEN 'Deletion'
    WHEN length(ref) = 1 AND length(alt) > 1 THEN 'Insertion' ELSE 'MNV/Complex' END AS variant_type, count(*) AS n FROM variants WHERE ref <> alt GROUP BY 1""",
    ["variants"],
)
def _(x):
    return variants.variant_type_counts(x.variants.where("ref <> alt"))


@query("variant_filter", "SELECT var_id, qual, maf FROM variants WHERE qual >= 30 AND coalesce(maf, 1) <= 0.05 AND var_id % 3 <> 1", ["variants"])
def _(x):
    effect = F.element_at(F.array(F.lit("A|MISSENSE|x"), F.lit("A|INTRON|x"), F.lit("A|STOP|x")), (F.col("var_id") % 3 + 1).cast("int"))
    return variants.variant_filter(x.variants.withColumn("ann", effect)).select("var_id", "qual", "maf")


@query(
    "trim_alleles",
    """WITH s AS (SELECT var_id, chrom, pos, ref, alt, least(length(ref), length(alt)) - 1 AS most FROM variants WHERE ref <> alt),
    k AS (SELECT *, CASE WHEN most >= 2 AND right(ref, 2) = right(alt, 2) THEN 2 WHEN most >= 1 AND right(ref, 1) = right(alt, 1) THEN 1 ELSE 0 END AS k FROM s),
    t AS (SELECT var_id, chrom, pos, left(ref, length(ref) - k) AS r, left(alt, length(alt) - k) AS a FROM k),
    p AS (SELECT *, CASE WHEN least(length(r), length(a)) >= 3 AND left(r, 2) = left(a, 2) THEN 2 WHEN least(length(r), length(a)) >= 2 AND left(r, 1) = left(a, 1) THEN 1 ELSE 0 END AS p FROM t)
    SELECT var_id, chrom, pos + p AS pos, substr(r, p + 1) AS ref, substr(a, p + 1) AS alt FROM p""",
    ["variants"],
)
def _(x):
    return variants.trim_alleles(x.variants.where("ref <> alt").select("var_id", "chrom", "pos", "ref", "alt"))


_POP = """SELECT 'A' AS chrom, p_partkey AS pos, substr('ACGTACGT', 1 + CAST(p_partkey % 4 AS INT), 1 + CAST(p_size % 3 AS INT)) AS ref,
    substr('CGTACGTA', 1 + CAST(p_partkey % 4 AS INT), 1) AS alt, p_retailprice / 100000.0{d} AS af, p_type FROM part"""


def _population(x):
    return x.table("part").selectExpr(
        "'A' AS chrom", "p_partkey AS pos", "substr('ACGTACGT', 1 + CAST(p_partkey % 4 AS INT), 1 + CAST(p_size % 3 AS INT)) AS ref",
        "substr('CGTACGTA', 1 + CAST(p_partkey % 4 AS INT), 1) AS alt", "p_retailprice / 100000.0D AS af", "p_type",
    )


@query(
    "annotate_frequency",
    f"""WITH pop AS ({_POP.format(d="::DOUBLE")}) SELECT var_id, round(af, 6) AS af, coalesce(af < 0.01, TRUE) AS rare FROM variants LEFT JOIN pop USING (chrom, pos, ref, alt)""",
    ["variants"],
)
def _(x):
    return variants.annotate_frequency(x.variants, _population(x)).select("var_id", F.round("af", 6).alias("af"), "rare")


@query(
    "annotate_significance",
    f"""WITH pop AS ({_POP.format(d="::DOUBLE")}), c AS (SELECT *, CASE WHEN af < 0.012 THEN 'Pathogenic' WHEN af < 0.014 THEN 'Likely pathogenic' WHEN af < 0.016 THEN 'Likely benign' ELSE 'Benign' END AS label FROM pop)
    SELECT var_id, label, CASE label WHEN 'Pathogenic' THEN 'P' WHEN 'Likely pathogenic' THEN 'LP' WHEN 'Likely benign' THEN 'LB' WHEN 'Benign' THEN 'B' ELSE 'VUS' END AS code
    FROM variants LEFT JOIN c USING (chrom, pos, ref, alt)""",
    ["variants"],
)
def _(x):
    af = F.col("af")
    label = F.when(af < 0.012, "Pathogenic").when(af < 0.014, "Likely pathogenic").when(af < 0.016, "Likely benign").otherwise("Benign")
    return variants.annotate_significance(x.variants, _population(x).withColumn("label", label)).select("var_id", "label", "code")


@query(
    "acmg_classify",
    """WITH e AS (SELECT l_orderkey AS var_id, CASE WHEN l_quantity < 6 THEN 'PVS1' WHEN l_quantity < 12 THEN 'PS2' WHEN l_quantity < 30 THEN 'PM3' WHEN l_quantity < 36 THEN 'BA1' WHEN l_quantity < 42 THEN 'BS2' ELSE 'OTHER' END AS c FROM lineitem),
    t AS (SELECT var_id, sum((c LIKE 'PVS%' OR c LIKE 'PS%')::INT) AS strong, sum((c LIKE 'PM%')::INT) AS moderate, sum((c LIKE 'BA%')::INT) AS benign_strong, sum((c LIKE 'BS%')::INT) AS benign_support FROM e GROUP BY var_id)
    SELECT *, CASE WHEN strong + moderate > 0 AND benign_strong + benign_support > 0 THEN 'VUS' WHEN strong >= 2 OR (strong = 1 AND moderate >= 3) THEN 'P' WHEN strong = 1 AND moderate >= 1 THEN 'LP'
    WHEN benign_strong >= 2 THEN 'B' WHEN benign_strong = 1 OR benign_support >= 2 THEN 'LB' ELSE 'VUS' END AS acmg_class FROM t""",
)
def _(x):
    q = F.col("l_quantity")
    c = F.when(q < 6, "PVS1").when(q < 12, "PS2").when(q < 30, "PM3").when(q < 36, "BA1").when(q < 42, "BS2").otherwise("OTHER")
    return variants.classify_evidence(x.table("lineitem").select(F.col("l_orderkey").alias("var_id"), c.alias("criterion")))


@query("variant_positions", "SELECT l_orderkey * 10 + l_linenumber AS var_id, l_linenumber AS chrom_number, l_partkey AS pos FROM lineitem WHERE l_returnflag <> 'N'")
def _(x):
    chrom = F.when(F.col("l_returnflag") == "N", "chrX").otherwise(F.concat(F.lit("chr"), F.col("l_linenumber")))
    v = x.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("var_id"), chrom.alias("chrom"), F.col("l_partkey").alias("pos"))
    return variants.plot_positions(v).select("var_id", "chrom_number", "pos")


@query(
    "allele_freq",
    """SELECT locus, population, count(*) AS n, round(sum(gt) / (2.0 * count(*)), 6) AS p, round(avg((gt = 1)::INT), 6) AS het_observed,
    round(2 * (sum(gt) / (2.0 * count(*))) * (1 - sum(gt) / (2.0 * count(*))), 6) AS het_expected FROM genotypes GROUP BY locus, population""",
    ["genotypes"],
)
def _(x):
    r = popgen.allele_freq(x.genotypes)
    return r.select("locus", "population", "n", *[F.round(c, 6).alias(c) for c in ("p", "het_observed", "het_expected")])


@query(
    "fst",
    """WITH p AS (SELECT locus, population, sum(gt) AS s, count(*) AS n FROM genotypes GROUP BY ALL),
    t AS (SELECT locus, avg(2 * (s / (2.0 * n)) * (1 - s / (2.0 * n))) AS hs, sum(s) / (2.0 * sum(n)) AS pt FROM p GROUP BY locus)
    SELECT locus, round(hs, 6) AS hs, round(2 * pt * (1 - pt), 6) AS ht, round((2 * pt * (1 - pt) - hs) / (2 * pt * (1 - pt)), 6) AS fst FROM t""",
    ["genotypes"],
)
def _(x):
    return popgen.fst(x.genotypes).select("locus", *[F.round(c, 6).alias(c) for c in ("hs", "ht", "fst")])


@query(
    "linkage_d",
    """SELECT a.locus AS locus_a, b.locus AS locus_b, count(*) AS n, round(sum(a.gt * b.gt) / (4.0 * count(*)) - (sum(a.gt) / (2.0 * count(*))) * (sum(b.gt) / (2.0 * count(*))), 4) AS d
    FROM genotypes a JOIN genotypes b ON a.individual = b.individual AND a.locus < b.locus GROUP BY ALL""",
    ["genotypes"],
)
def _(x):
    return popgen.ld_d(x.genotypes)


@query("population_sizes", "SELECT population, count(DISTINCT individual) AS n_individuals FROM genotypes GROUP BY population", ["genotypes"])
def _(x):
    return popgen.population_sizes(x.genotypes)

"""Registered queries on gene sets and pathways."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog.base import query
from strandframe.operators import enrichment as E

_ORA = """u AS (SELECT p_partkey AS gene FROM part), g AS (SELECT gene FROM ranks WHERE stat > 0 AND gene IN (SELECT gene FROM u)),
    t AS (SELECT (SELECT count(*) FROM u) AS nn, (SELECT count(*) FROM g) AS n),
    s AS (SELECT {lib}gs_name, count(*) AS set_size, count(g.gene) AS overlap_count, coalesce(string_agg(g.gene::VARCHAR, ',' ORDER BY g.gene), '') AS overlap_genes FROM (SELECT DISTINCT * FROM {sets}) m LEFT JOIN g USING (gene) GROUP BY ALL HAVING count(g.gene) >= 1),
    x AS (SELECT *, list_sum(list_transform(range(overlap_count, least(set_size, n) + 1), lambda i: exp(lgamma(set_size + 1) - lgamma(i + 1) - lgamma(set_size - i + 1) + lgamma(nn - set_size + 1) - lgamma(n - i + 1) - lgamma(nn - set_size - n + i + 1)
        - lgamma(nn + 1) + lgamma(n + 1) + lgamma(nn - n + 1)))) AS p, overlap_count * (nn - set_size - n + overlap_count) / ((set_size - overlap_count) * (n - overlap_count))::DOUBLE AS odds FROM s, t),
    r AS (SELECT *, rank() OVER ({part} ORDER BY p DESC) AS dr, count(*) OVER ({part}) AS m FROM x)
    SELECT {lib}gs_name, set_size, overlap_count, overlap_genes, round(p, 6) AS p_value, round(odds, 6) AS odds_ratio, round(-ln(p) * odds, 5) AS combined_score,
    round(least(1.0, min(p * m / (m - dr + 1)) OVER ({part} ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS adjusted_p_value, row_number() OVER ({part} ORDER BY p, gs_name) AS rank FROM r"""


def _rounded(df):
    six = ("p_value", "odds_ratio", "adjusted_p_value")
    return df.select(*[F.round(c, 6).alias(c) if c in six else F.round(c, 5).alias(c) if c == "combined_score" else F.col(c) for c in df.columns])


@query("ora", "WITH " + _ORA.format(lib="", sets="gene_sets", part=""), ["ranks", "gene_sets"])
def _(x):
    universe = x.table("part").select(F.col("p_partkey").alias("gene"))
    return _rounded(E.ora(x.ranks.where("stat > 0"), x.gene_sets, universe))


@query(
    "ora_by_library",
    "WITH gl AS (SELECT *, CASE WHEN gs_name LIKE 'Brand%' THEN 'brand' ELSE 'type' END AS lib FROM gene_sets), " + _ORA.format(lib="lib, ", sets="gl", part="PARTITION BY lib"),
    ["ranks", "gene_sets"],
)
def _(x):
    universe = x.table("part").select(F.col("p_partkey").alias("gene"))
    named = x.gene_sets.withColumn("lib", F.when(F.col("gs_name").startswith("Brand"), "brand").otherwise("type"))
    return _rounded(E.ora(x.ranks.where("stat > 0"), named, universe, library="lib"))


# sets of about 40 genes at every table size, and those of one brand and type
_SETS3 = """gs AS (SELECT concat('s', p_partkey % greatest(1, (SELECT count(*) FROM part) // 40)) AS gs_name, p_partkey AS gene FROM part UNION ALL SELECT concat(p_brand, '/', p_type), p_partkey FROM part)"""


def _fine_sets(x):
    part = x.table("part")
    n = part.agg(F.count(F.lit(1)).alias("_n"))
    dealt = part.join(F.broadcast(n), F.lit(True)).select(F.concat(F.lit("s"), F.col("p_partkey") % F.greatest(F.lit(1), F.floor(F.col("_n") / 40))).alias("gs_name"), F.col("p_partkey").alias("gene"))
    return dealt.unionAll(part.select(F.concat_ws("/", "p_brand", "p_type"), "p_partkey"))


_PLACED = "pl AS (SELECT gene, stat, row_number() OVER (ORDER BY stat DESC, gene) AS pos, count(*) OVER () AS nn FROM ranks)"


def _scores_sql(name: str, hits: str, keys: str) -> str:
    """Running-sum scores of hit rows (keys, gene, pos, nn, w)."""
    return f"""{name}_h AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS i, count(*) OVER (PARTITION BY {keys}) AS size, sum(w) OVER (PARTITION BY {keys}) AS nr,
        sum(w) OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM {hits}),
    {name}_d AS (SELECT *, c / nr - (pos - i) / (nn - size)::DOUBLE AS top, (c - w) / nr - (pos - i) / (nn - size)::DOUBLE AS low FROM {name}_h),
    {name}_e AS (SELECT {keys}, any_value(size) AS size, max(top) AS mx, min(low) AS mn, arg_min(pos, (-top, pos)) AS pmx, arg_min(pos, (low, pos)) AS pmn FROM {name}_d GROUP BY {keys}),
    {name} AS (SELECT {keys}, size, CASE WHEN mx >= -mn THEN mx ELSE mn END AS es, CASE WHEN mx >= -mn THEN pmx ELSE pmn END AS peak FROM {name}_e)"""


_OBSERVED = f"""{_SETS3}, {_PLACED}, hs AS (SELECT gs_name, gene, pos, nn, abs(stat) AS w FROM gs JOIN pl USING (gene) QUALIFY count(*) OVER (PARTITION BY gs_name) BETWEEN 15 AND 500),
    {_scores_sql("sc", "hs", "gs_name")}, ed AS (SELECT gs_name, count(*) AS leading_edge, string_agg(gene::VARCHAR, ',' ORDER BY pos) AS leading_genes FROM hs JOIN sc USING (gs_name)
        WHERE (es >= 0 AND pos <= peak) OR (es < 0 AND pos >= peak) GROUP BY gs_name)"""


@query(
    "gsea_scores",
    f"""WITH {_OBSERVED} SELECT gs_name, sc.size, round(es, 6) AS es, peak AS peak_position, leading_edge, leading_genes FROM sc JOIN ed USING (gs_name)""",
    ["ranks"],
)
def _(x):
    found = E.gsea_scores(x.ranks, _fine_sets(x))
    return found.withColumn("es", F.round("es", 6)).withColumn("leading_genes", F.array_join("leading_genes", ","))


#: Permutations of the registered test.
_PERMS = 60


@query(
    "gsea",
    f"""WITH {_OBSERVED}, sz AS (SELECT DISTINCT size AS k FROM sc),
    dr AS (SELECT perm, pos, nn, w, row_number() OVER (PARTITION BY perm ORDER BY h, gene) AS j FROM (SELECT perm, gene, pos, nn, abs(stat) AS w, ('0x' || substr(md5(gene || ':' || perm), 1, 15))::BIGINT AS h FROM pl, range(1, {_PERMS + 1}) r(perm)) q),
    nh AS (SELECT perm, k, pos, nn, w FROM dr JOIN sz ON j <= k), {_scores_sql("nu", "nh", "perm, k")},
    ns AS (SELECT gs_name, any_value(sc.size) AS size, any_value(sc.es) AS es, count(nu.es) AS n, count(nu.es) FILTER (abs(nu.es) >= abs(sc.es)) AS beyond, avg(abs(nu.es)) AS m
        FROM sc LEFT JOIN nu ON nu.k = sc.size AND (nu.es >= 0) = (sc.es >= 0) GROUP BY gs_name),
    pv AS (SELECT *, CASE WHEN n > 0 THEN (beyond + 1) / (n + 1)::DOUBLE END AS p FROM ns), rk AS (SELECT *, rank() OVER (ORDER BY p DESC) AS dr, count(*) OVER () AS tests FROM pv WHERE p IS NOT NULL),
    bh AS (SELECT gs_name, least(1.0, min(p * tests / (tests - dr + 1)) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS padj FROM rk)
    SELECT gs_name, pv.size, round(es, 6) AS es, round(es / m, 5) AS nes, round(p, 6) AS pval, round(padj, 6) AS padj, leading_edge, leading_genes FROM pv JOIN ed USING (gs_name) LEFT JOIN bh USING (gs_name)""",
    ["ranks"],
)
def _(x):
    deal = lambda gene, perm: F.conv(F.substring(F.md5(F.concat(gene.cast("string"), F.lit(":"), perm.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    found = E.gsea(x.ranks, _fine_sets(x), n_perm=_PERMS, shuffle=deal)
    return found.select(
        "gs_name", "size", F.round("es", 6).alias("es"), F.round("nes", 5).alias("nes"), F.round("pval", 6).alias("pval"), F.round("padj", 6).alias("padj"),
        "leading_edge", F.array_join("leading_genes", ",").alias("leading_genes"),
    )


@query("gene_set_query", "SELECT p_brand AS gs_name, count(DISTINCT p_partkey) AS n_genes, string_agg(DISTINCT p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS genes FROM part WHERE p_type = 'ECONOMY' GROUP BY 1")
def _(x):
    sets = x.table("part").select(F.col("p_brand").alias("gs_name"), F.col("p_partkey").cast("string").alias("gene"), F.col("p_type").alias("collection"))
    return E.gene_set_query(sets, collection="ECONOMY").withColumn("genes", F.array_join("genes", ","))


_OVERLAPPING = """SELECT DISTINCT concat('q', l_quantity::INT) AS gs_name, l_partkey % 1000 AS gene FROM lineitem"""


@query(
    "redundancy_filter",
    f"""WITH s AS ({_OVERLAPPING}), k AS (SELECT gs_name, count(*) AS k, list(gene) AS g FROM s GROUP BY 1), t AS (SELECT gs_name, k, g, (k * 7919 % 97) / 97.0::DOUBLE AS p FROM k)
    SELECT gs_name, round(p, 6) AS p_value FROM t WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.gs_name <> t.gs_name AND (b.p < t.p OR (b.p = t.p AND b.gs_name < t.gs_name))
    AND len(list_intersect(b.g, t.g)) > 0.7 * least(b.k, t.k))""",
)
def _(x):
    sets = x.table("lineitem").select(F.concat(F.lit("q"), F.col("l_quantity").cast("int")).alias("gs_name"), (F.col("l_partkey") % 1000).alias("gene")).distinct()
    terms = sets.groupBy("gs_name").agg(F.count(F.lit(1)).alias("k")).select("gs_name", (F.col("k") * 7919 % 97 / F.lit(97.0)).alias("p_value"))
    return E.redundancy_filter(terms, sets).withColumn("p_value", F.round("p_value", 6))


_FOUND = """SELECT p_partkey AS id, p_name AS name, CASE WHEN contains(lower(p_name), 'blue ring') THEN 0.9 ELSE 0.6 END AS score FROM part
    WHERE contains(lower(p_name), 'blue') OR contains(lower(p_name), 'ring')"""


def _pathways(x):
    return x.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))


@query("pathway_search", f"SELECT * FROM ({_FOUND}) t ORDER BY score DESC, id LIMIT 10")
def _(x):
    return E.pathway_search(_pathways(x), "Blue ring").drop("ord")


@query("pathway_design", f"SELECT *, CASE WHEN place = 1 THEN concat('Consider using pathway ', id, ' for blue ring production') END AS suggestion FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM ({_FOUND}) t) u WHERE place <= 5")
def _(x):
    return E.pathway_design(_pathways(x), "blue ring")


@query("gene_summaries", "SELECT doc_id AS id, source AS name, left(text, 300) AS summary, length(text) AS length FROM documents WHERE contains(lower(text), 'the')")
def _(x):
    return E.gene_summaries(x.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("summary")), "the")


@query("symbol_case", "SELECT p_partkey, upper(p_type) AS human, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS mouse FROM part")
def _(x):
    return x.table("part").select("p_partkey", E.symbol_case(F.col("p_type"), "human").alias("human"), E.symbol_case(F.col("p_type"), "mouse").alias("mouse"))

"""Gene-set over-representation, ranked enrichment and catalogue queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.discrete import hyper_upper
from strandframe.operators.hypothesis import bh_fdr
from strandframe.plans import scan
from strandframe.plans.storage import spread_rows


def ora(genes: DataFrame, sets: DataFrame, universe: DataFrame, min_overlap: int = 1, library: str | None = None) -> DataFrame:
    """Over-representation of a gene list in gene sets.

    One-sided hypergeometric p, odds ratio of the 2 x 2 table (null when a
    margin cell is zero), combined score -ln(p) * odds ratio, BH q and rank.
    With ``library`` (a column of ``sets``) libraries are never mixed.
    """
    if not genes.take(1):
        raise ValueError("genes must be a non-empty list of gene symbols")
    keys = [library] if library else []
    known = universe.select("gene").distinct()
    picked = genes.select("gene").distinct().join(known, "gene", "left_semi").withColumn("_hit", F.lit(1))
    totals = known.agg(F.count(F.lit(1)).alias("_universe")).join(F.broadcast(picked.agg(F.count(F.lit(1)).alias("_picked"))), F.lit(True))
    members = sets.select(*keys, "gs_name", "gene").distinct().join(known, "gene", "left_semi").join(picked, "gene", "left")
    per = members.groupBy(*keys, "gs_name").agg(
        F.count(F.lit(1)).alias("set_size"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("overlap_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_hit") == 1, F.col("gene")))), ",").alias("overlap_genes"),
    ).where(F.col("overlap_count") >= min_overlap)
    j = spread_rows(per).join(F.broadcast(totals), F.lit(True))
    hits, picks, size, everything = F.col("overlap_count"), F.col("_picked"), F.col("set_size"), F.col("_universe")
    out = scan.cut_lineage(j.withColumn("p_value", hyper_upper(hits, picks, size, everything)))
    out = out.withColumn("odds_ratio", hits * (everything - size - picks + hits) / F.nullif((size - hits) * (picks - hits), F.lit(0)).cast("double"))
    out = out.withColumn("combined_score", -F.log(F.greatest("p_value", F.lit(1e-300))) * F.col("odds_ratio")).drop("_universe", "_picked")
    adjusted = bh_fdr(out, "p_value", by=keys, out="adjusted_p_value")
    place = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("p_value", "gs_name")  # one row per term
    return adjusted.withColumn("rank", F.row_number().over(place))


def rank_genes(ranks: DataFrame) -> DataFrame:
    """Positions of genes by falling statistic, first entry of a repeated name kept."""
    clean = ranks.where(F.col("stat").isNotNull()).groupBy("gene").agg(F.max("stat").alias("stat"))
    return scan.row_positions(clean, [F.desc("stat"), F.asc("gene")])


def _scores(hits: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """Running-sum score per set from its hit rows (position, weight, total).

    Between hits the sum falls linearly with rank, so only hit rows are needed:
    the top lies after a hit, the bottom before one.
    """
    w = Window.partitionBy(*keys).orderBy("position")
    every = Window.partitionBy(*keys)
    i = F.row_number().over(w)
    size = F.count(F.lit(1)).over(every)
    norm = F.sum("weight").over(every)
    cum = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))
    missing = (F.col("position") - i) / (total - size)
    marked = hits.select(
        *keys, "position", size.alias("size"),
        (cum / norm - missing).alias("_top"), ((cum - F.col("weight")) / norm - missing).alias("_low"),
    )
    s = marked.groupBy(*keys).agg(
        F.max("size").alias("size"), F.max("_top").alias("_mx"), F.min("_low").alias("_mn"),
        F.min_by("position", F.struct(-F.col("_top"), "position")).alias("_at_max"), F.min_by("position", F.struct("_low", "position")).alias("_at_min"),
    )
    up = F.col("_mx") >= -F.col("_mn")
    return s.select(*keys, "size", F.when(up, F.col("_mx")).otherwise(F.col("_mn")).alias("es"), F.when(up, F.col("_at_max")).otherwise(F.col("_at_min")).alias("peak_position"))


def _sized_hits(placed: DataFrame, sets: DataFrame, min_size: int, max_size: int) -> DataFrame:
    """Hit rows of the sets whose size in the ranking lies within bounds."""
    hits = sets.select("gs_name", "gene").distinct().join(placed, "gene")
    fit = hits.groupBy("gs_name").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k").between(min_size, max_size)).select("gs_name")
    return hits.join(fit, "gs_name", "left_semi").select("gs_name", "gene", "position", F.abs("stat").alias("weight"))


def gsea_scores(ranks: DataFrame, sets: DataFrame, min_size: int = 15, max_size: int = 500) -> DataFrame:
    """Enrichment score, size and leading edge per set: the number of its genes and their names, in order of rank.

    The leading edge reaches from the top to the peak of a positive score and from
    the dip to the bottom of a negative one.
    """
    placed = rank_genes(ranks)
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    hits = _sized_hits(placed, sets, min_size, max_size).join(F.broadcast(n), F.lit(True))
    return _with_edge(hits, _scores(hits, ["gs_name"], F.col("_n")))


def _with_edge(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """A set has at most ``max_size`` hit rows, so its names fit a row."""
    edge = hits.select("gs_name", "gene", "position").join(scores, "gs_name").where(
        F.when(F.col("es") >= 0, F.col("position") <= F.col("peak_position")).otherwise(F.col("position") >= F.col("peak_position"))
    )
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "gene"))), lambda g: g["gene"])
    return scores.join(edge.groupBy("gs_name").agg(F.count(F.lit(1)).alias("leading_edge"), names.alias("leading_genes")), "gs_name")


def _drawn(placed: DataFrame, n: int, most: int, n_perm: int, shuffle) -> DataFrame:
    """The first ``most`` genes of every permutation: perm, place, position, weight.

    A permutation orders genes by a hash in [0, 2**60); only genes below a bound
    that leaves more than ``most`` of them are ordered.  Should a permutation fall
    short of it, the bound is doubled.
    """
    wanted = min(most, n)
    bound = (wanted + 8 * wanted**0.5 + 32) / max(n, 1)
    while True:
        low = placed.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm)))).withColumn("_h", shuffle(F.col("gene"), F.col("perm")))
        if bound < 1:
            low = low.where(F.col("_h") < int(bound * (1 << 60)))
        low = scan.cut_lineage(low.select("perm", "_h", "gene", "position", F.abs("stat").alias("weight")))
        enough = low.groupBy("perm").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= wanted).count() == n_perm
        if enough or bound >= 1:
            order = Window.partitionBy("perm").orderBy("_h", "gene")
            return low.withColumn("_j", F.row_number().over(order)).where(F.col("_j") <= most).select("perm", "_j", "position", "weight")
        bound *= 2


def gsea(ranks: DataFrame, sets: DataFrame, min_size: int = 15, max_size: int = 500, n_perm: int = 200, shuffle=None) -> DataFrame:
    """Scores with normalised score, permutation p, BH q and leading edge.

    Each permutation orders the genes by a seeded hash (``shuffle`` of gene and
    permutation number, uniform in [0, 2**60)) and gives nested random sets of every
    needed size; p compares scores of the same sign, one added.  A sign that no
    permutation of that size gives has null nes, p and q.
    """
    placed = scan.cut_lineage(rank_genes(ranks))
    shuffle = shuffle or (lambda gene, perm: F.shiftrightunsigned(F.xxhash64(gene, perm), 4))
    total = placed.count()
    n = F.lit(total)
    hits = _sized_hits(placed, sets, min_size, max_size)
    observed = scan.cut_lineage(_with_edge(hits, _scores(hits, ["gs_name"], n)))
    sizes = observed.select(F.col("size").alias("k")).distinct()  # at most max_size rows
    most = sizes.agg(F.max("k")).first()[0] or 0
    drawn = _drawn(placed, total, most, n_perm, shuffle)
    nested = drawn.join(F.broadcast(sizes), F.col("_j") <= F.col("k"))
    null = _scores(nested, ["perm", "k"], n).groupBy("k", (F.col("es") >= 0).alias("_up")).agg(F.collect_list("es").alias("_null"))
    joined = observed.join(null, (F.col("size") == F.col("k")) & ((F.col("es") >= 0) == F.col("_up")), "left")
    beyond = F.size(F.filter("_null", lambda e: F.abs(e) >= F.abs(F.col("es"))))
    mean = F.aggregate("_null", F.lit(0.0), lambda a, e: a + F.abs(e)) / F.size("_null")
    given = F.col("_null").isNotNull()
    out = joined.select(
        "gs_name", "size", "es", F.when(given & (mean > 0), F.col("es") / F.nullif(mean, F.lit(0.0))).alias("nes"),
        F.when(given, (beyond + 1) / (F.size("_null") + 1)).alias("pval"), "leading_edge", "leading_genes",
    )
    return bh_fdr(scan.cut_lineage(out), "pval", out="padj")


def gene_set_query(sets: DataFrame, **filters: str) -> DataFrame:
    """Sets matching catalogue fields, with their sorted members and their number; a set fits a row."""
    kept = sets
    for column, value in filters.items():
        kept = kept.where(F.col(column) == value)
    return kept.groupBy("gs_name").agg(F.count_distinct("gene").alias("n_genes"), F.array_sort(F.collect_set("gene")).alias("genes"))


def redundancy_filter(terms: DataFrame, sets: DataFrame, share: float = 0.7) -> DataFrame:
    """Drop a term when a better one shares more than ``share`` of the smaller set.

    One pass: every term is compared with all better terms (smaller p, then
    name).  Candidate pairs come from the rarest genes of the smaller set, as
    many as any such overlap must touch, and are verified on the full sets.
    """
    members = sets.select("gs_name", "gene").distinct().join(terms.select("gs_name"), "gs_name", "left_semi")
    freq = members.groupBy("gene").agg(F.count(F.lit(1)).alias("_f"))
    whole = members.groupBy("gs_name").agg(F.collect_list("gene").alias("_genes")).withColumn("_k", F.size("_genes"))
    scored = terms.select("gs_name", "p_value").join(whole, "gs_name")
    need = F.floor(F.col("_k") * share) + 1
    rarest = (
        members.join(freq, "gene").groupBy("gs_name").agg(F.array_sort(F.collect_list(F.struct("_f", "gene"))).alias("_o")).withColumn("_k", F.size("_o"))
        .select("gs_name", F.explode(F.slice("_o", F.lit(1), (F.col("_k") - need + 1).cast("int"))).alias("o")).select("gs_name", F.col("o.gene").alias("gene"))
    )
    pairs = rarest.select(F.col("gs_name").alias("a"), "gene").join(members.select(F.col("gs_name").alias("b"), "gene"), "gene").where(F.col("a") != F.col("b")).select("a", "b").distinct()
    one = lambda s: scored.select(F.col("gs_name").alias(s), F.col("p_value").alias(f"p{s}"), F.col("_genes").alias(f"g{s}"), F.col("_k").alias(f"k{s}"))
    close = pairs.join(one("a"), "a").join(one("b"), "b").where(
        (F.col("ka") <= F.col("kb")) & (F.size(F.array_intersect("ga", "gb")) > share * F.col("ka"))
    )
    a_better = (F.col("pa") < F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("a") < F.col("b")))
    worse = close.select(F.when(a_better, F.col("b")).otherwise(F.col("a")).alias("gs_name")).distinct()
    return terms.join(worse, "gs_name", "left_anti")


def pathway_search(pathways: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Catalogue search over ``(id, name, ord)``.

    Names holding the whole text score 0.9, names holding any word 0.6; the
    first ``limit`` by score, then catalogue order.
    """
    name = F.lower("name")
    whole = name.contains(text.lower())
    words = [w for w in text.lower().split() if w]
    any_word = F.lit(False)
    for w in words:
        any_word = any_word | name.contains(w)
    scored = pathways.withColumn("score", F.when(whole, 0.9).when(any_word, 0.6)).where(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), "ord").limit(limit)


def pathway_design(pathways: DataFrame, target: str) -> DataFrame:
    """The five best pathways, the best one marked with its suggestion."""
    top = pathway_search(pathways, target, 5).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "ord")))
    note = F.when(F.col("place") == 1, F.concat(F.lit("Consider using pathway "), F.col("id").cast("string"), F.lit(f" for {target} production")))
    return top.select("id", "name", "score", "place", note.alias("suggestion"))


def gene_summaries(genes: DataFrame, text: str, length: int = 300) -> DataFrame:
    """Gene records whose whole summary mentions ``text``, with a short summary."""
    return genes.where(F.lower("summary").contains(text.lower())).select("id", "name", F.left("summary", F.lit(length)).alias("summary"), F.length("summary").alias("length"))


def symbol_case(symbol: Column, species: str) -> Column:
    """Human symbols upper case, mouse symbols capitalised."""
    return F.upper(symbol) if species == "human" else F.initcap(F.lower(symbol))

"""Mixing sources to target weights down a domain-language-source tree (column expressions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.common import stored
from strandframe.plans.scan import running

LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """``hub`` for source names that end in 0, ``web`` otherwise."""
    return F.when(source.endswith("0"), F.lit("hub")).otherwise(F.lit("web"))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _share(nodes: DataFrame, parent: Sequence[str], weight: Column) -> DataFrame:
    """Split each parent's ``grant`` by weight under the caps ``cap``: what a full child leaves goes to its siblings.

    Children in order of cap / weight fill up first; the first that does not
    fill fixes the common level for the rest (levels only fall after it, so it is the largest).
    """
    nodes = nodes.withColumn("_w", weight).withColumn("_r", F.col("cap") / F.col("_w"))
    order = Window.partitionBy(*parent).orderBy("_r", *[c for c in LEVELS if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spent, weights = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.sum("_w").over(onward)
    nodes = nodes.withColumn("_level", (F.col("grant") - spent) / weights)
    first = F.max(F.when(F.col("_r") > F.col("_level"), F.col("_level"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return nodes.withColumn("grant", F.when(first.isNull(), F.col("cap").cast("double")).otherwise(F.col("_w") * first)).drop("_w", "_r", "_level")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, float]], epochs: int) -> DataFrame:
    """``grant`` tokens of every leaf (domain, lang, source, tokens).

    A node's cap is ``epochs`` times its tokens, so a shortage is made up by
    siblings below the same parent as long as they can, and only then above.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    grants = leaves.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("_c"), F.coalesce(total, F.lit(0)).alias("_t")).select(F.least("_c", "_t").cast("double").alias("grant"))
    keys: list[str] = []
    for level in LEVELS:
        given = weights.get(level, {})
        weight = F.coalesce(*[F.when(F.col(level) == k, F.lit(float(w))) for k, w in given.items()], F.lit(1.0))
        nodes = leaves.groupBy(*keys, level).agg(F.sum("cap").alias("cap"))
        joined = nodes.join(grants, keys) if keys else nodes.crossJoin(F.broadcast(grants))  # one row
        keys.append(level)
        grants = _share(joined, keys[:-1], weight).select(*keys, "grant")
    return leaves.join(grants, keys)


def mixed(
    docs: DataFrame, weights: dict[str, dict[str, float]] | None = None, fraction: float = 0.75, epochs: int = 4, seed: int = 7
) -> DataFrame:
    """Columns of ``docs`` plus n_tokens, leaf domain, epoch: one row for every use of a document.

    ``weights`` gives relative weights per level (1 where absent); the total is
    ``fraction`` of all tokens; a leaf is read in whole epochs, each in its own
    seeded order, and in the last one up to the document that reaches the
    grant.  Null lang or source counts as ``?``; documents without tokens are used
    whenever their epoch reaches them; equal doc_ids are told apart by text
    hash.  An empty table gives no rows.
    """
    names = docs.columns
    mark = {c: f"_{c}_mix" for c in (*LEVELS, "tokens", "use", "end", "block", "order", "id")}
    base = docs.withColumn(mark["tokens"], n_tokens(F.col("text")))
    base = base.withColumn(mark["lang"], F.coalesce("lang", F.lit("?"))).withColumn(mark["source"], F.coalesce("source", F.lit("?")))
    base = stored(base.withColumn(mark["domain"], domain_of(F.col(mark["source"]))).withColumn(mark["id"], F.monotonically_increasing_id()), "mix")
    slim = base.select(mark["id"], F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_h"), F.col(mark["tokens"]).alias("tokens"), *[F.col(mark[c]).alias(c) for c in LEVELS])
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, F.sum("tokens") * fraction, weights or {}, epochs)
    plan = plan.select(*LEVELS, "grant", F.col("tokens").alias("_leaf"))
    uses = slim.join(plan, list(LEVELS)).withColumn("whole", F.floor(F.col("grant") / F.greatest("_leaf", F.lit(1))).cast("int"))
    # whole epochs need no order; only the last, partial one is scanned
    last = uses.withColumn("_order", F.xxhash64(F.lit(seed), F.col("whole"), F.col("_doc"), F.col("_h"), F.col(mark["id"]))).withColumn("_block", F.shiftright("_order", 56).cast("int"))
    last = running(last, list(LEVELS), ["_order"], "_block", [("_before", "tokens", "sum", "before")])
    taken = last.where((F.col("whole") < epochs) & (F.col("_before") < F.col("grant") - F.col("whole") * F.col("_leaf"))).select(mark["id"], F.col("whole").alias("epoch"))
    full = uses.where("whole > 0").select(mark["id"], F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"))
    picks = full.union(taken).withColumnRenamed("epoch", mark["use"])
    out = base.join(picks, mark["id"])
    return out.select(*names, F.col(mark["domain"]).alias("mix_domain"), F.col(mark["tokens"]).alias("mix_tokens"), F.col(mark["use"]).alias("mix_epoch"))

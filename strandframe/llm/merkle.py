"""Merkle manifest of a dataset by cogrouped subtree exchange.

Rows are leaves of one tree per ``lang``, runs of eight nodes become one, and the
trees' roots are the leaves of the last tree.  A tree is cut into superblocks of
``FAN ** depth`` consecutive nodes.  Upward, a superblock is reduced to its top in one
group, and the tops are the nodes of the next layer.  Downward, the nodes of a
superblock are cogrouped with the outer nodes that it needs (the siblings of its
path above); the group reduces its nodes, joins the proofs and folds them at once.
Only nodes travel: texts stay behind, and no group is larger than a superblock.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.common import stored

FAN, DEPTH = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row; ``changed`` replaces columns by name."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in COLUMNS]), 256)


def _levels(nodes: list[str], block: int, depth: int) -> list[list[str]]:
    """Levels of a superblock, nodes to top.  Only a tree's first block can be its last, and then it ends at one node."""
    levels, whole = [nodes], block > 0 or len(nodes) == FAN**depth
    while len(levels) <= depth if whole else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_hash("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return levels


def _path(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Siblings left and right of node ``at`` on every level below the top."""
    steps = []
    for nodes in levels[:-1]:
        run = at - at % FAN
        steps.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + FAN])))
        at //= FAN
    return steps


def _block(depth: int) -> Column:
    return F.expr(f"pos div {FAN**depth}")


def positions(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, order columns ``o1``, ``o2``, ..., others) with ``pos``, the place in its tree from 0.

    Rows are dealt by ranges of (tree, order), sorted there and stored with their
    place in the range; one row per range and tree carries the offsets.
    """
    order = ["tree", *[c for c in nodes.columns if c[0] == "o" and c[1:].isdigit()]]
    placed = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = stored(placed.withColumns({"_range": F.spark_partition_id(), "_at": at}), "ranges")
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range", "tree").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    starts = starts.select("_range", "tree", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_off"))
    return placed.join(starts, ["_range", "tree"]).withColumn("pos", F.col("_at") + F.col("_off")).drop("_range", "_at", "_off", *order[1:])


def _tops(nodes: DataFrame, depth: int) -> DataFrame:
    """One node per superblock of ``nodes`` (tree, pos, node): tree, pos, node."""
    def reduce(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tree, block = key
        return pd.DataFrame({"tree": [tree], "pos": [block], "node": _levels(frame.sort_values("pos")["node"].tolist(), int(block), depth)[-1]})

    return nodes.select("tree", "pos", "node").groupBy("tree", _block(depth).alias("_block")).applyInPandas(reduce, "tree string, pos long, node string")


def layers(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """``nodes`` and the layers of superblock tops above, up to one node per tree (stored)."""
    found = [nodes]
    while True:
        found.append(stored(_tops(found[-1], depth), "tops"))
        if not found[-1].agg(F.max("pos")).first()[0]:
            return found


def _exchange(nodes: DataFrame, outer: DataFrame, given: list[str], depth: int) -> DataFrame:
    """``nodes`` (tree, pos, node and ``given``) with ``steps``, ``subroot``, ``root`` and ``folded`` of each.

    ``outer`` has one row per superblock: tree, pos (the block), steps above it,
    subroot, root.  ``folded`` goes from the column ``start`` where ``given`` has it.
    """
    begin = "start" if "start" in given else "node"

    def finish(key: tuple, inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos", ignore_index=True)
        levels = _levels(inner["node"].tolist(), int(key[1]), depth)
        tail = [(s["left"], s["right"]) for s in above["steps"].iloc[0]]
        steps, folded = [], []
        for at, h in enumerate(inner[begin]):
            path = _path(levels, at) + tail
            for left, right in path:
                h = _hash(left + h + right)
            steps.append([{"left": a, "right": b} for a, b in path])
            folded.append(h)
        same = {c: above[c].iloc[0] for c in ("subroot", "root")}
        return inner[["tree", "pos", *given]].assign(steps=steps, folded=folded, **same)

    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in given)
    left = nodes.withColumn("_block", _block(depth)).groupBy("tree", "_block")
    right = outer.withColumnRenamed("pos", "_block").groupBy("tree", "_block")
    schema = ", ".join(filter(None, ["tree string, pos long", kinds, f"steps {STEPS}, folded string, subroot string, root string"]))
    return left.cogroup(right).applyInPandas(finish, schema)


def _descend(levels: list[DataFrame], outer: DataFrame, depth: int) -> DataFrame:
    """Outer nodes of the superblocks of ``levels[0]``, from those of the top layer's only node per tree."""
    for nodes in reversed(levels[1:-1]):
        outer = stored(_exchange(nodes, outer, [], depth).drop("folded"), "outer")
    return outer


def manifest(docs: DataFrame, tampered: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """doc_id, lang, position, leaf, subroot, root, proof, folded_root, verified for every row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are ignored.
    ``proof`` lists the siblings left and right of the path, leaf to root.
    ``tampered`` is a text expression: the fold starts from the leaf of a row with
    that text, while all siblings stay; without it from the leaf itself.
    A tree's leaves ascend by doc_id (null first), equal ids by leaf; rows equal in
    every column are leaves of their own with equal digests.  Null ``lang`` is a
    tree, the first.  A single row is its own subroot and root, with an empty proof.
    An empty table gives an empty result.  A group holds ``8 ** depth`` nodes at most.
    """
    text = F.col("text") if tampered is None else tampered
    rows = docs.select(
        F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "lang")).alias("tree"),
        F.col("doc_id").alias("o1"), leaf().alias("o2"), F.monotonically_increasing_id().alias("o3"),
        "doc_id", "lang", leaf().alias("node"), leaf(text=text).alias("start"),
    )
    rows = stored(positions(stored(rows, "leaves")), "placed")
    if not rows.limit(1).count():
        return rows.sparkSession.createDataFrame(
            [], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, position long, leaf string, subroot string, root string, proof {STEPS}, folded_root string, verified boolean"
        )
    trees = layers(rows, depth)
    subroots = positions(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("o1"), F.col("tree").alias("name"), "node"))
    crown = layers(stored(subroots, "subroots"), depth)
    none = F.array().cast(STEPS)
    outer = crown[-1].select("tree", "pos", none.alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    tops = _exchange(crown[0], _descend(crown, outer, depth), ["name", "node"], depth)
    outer = stored(tops.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "steps", F.col("node").alias("subroot"), "root"), "outer")
    done = _exchange(rows, _descend(trees, outer, depth), ["doc_id", "lang", "node", "start"], depth)
    return done.select(
        "doc_id", "lang", F.col("pos").alias("position"), F.col("node").alias("leaf"), "subroot", "root", F.col("steps").alias("proof"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )

"""Trees as edge tables (tree_id, child, parent, blen), of any depth.

No operator forms all node-ancestor pairs.  Pointers double in reach every
round, so a tree of depth d takes log2(d) rounds over one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.plans import skew
from strandframe.plans.storage import cut_lineage

KEY = ["tree_id", "node"]
#: Pairs at one node beyond which they are spread over several tasks.
HOT_PAIRS = 1 << 17


def terminals(edges: DataFrame) -> DataFrame:
    inner = edges.select("tree_id", F.col("parent").alias("child")).distinct()
    return edges.join(inner, ["tree_id", "child"], "left_anti")


def tree_length(edges: DataFrame) -> DataFrame:
    return edges.groupBy("tree_id").agg(F.sum("blen").alias("total_length"), F.count(F.lit(1)).alias("n_edges"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("tree_id", F.col("child").alias("node")).unionAll(edges.select("tree_id", "parent")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that are no child (tree_id, node)."""
    return edges.select("tree_id", F.col("parent").alias("child")).distinct().join(edges, ["tree_id", "child"], "left_anti").select("tree_id", F.col("child").alias("node"))


def nearest_above(edges: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """node, anc, steps, length for every child node: its nearest proper ancestor that is ``marked`` (tree_id, node) or a root."""
    stops = roots(edges) if marked is None else marked.select(*KEY).unionByName(roots(edges)).distinct()
    at = edges.select("tree_id", F.col("child").alias("node"), F.col("parent").alias("anc"), F.lit(1).cast("long").alias("steps"), F.col("blen").cast("double").alias("length"))
    reach = cut_lineage(at.join(stops.select("tree_id", F.col("node").alias("anc"), F.lit(True).alias("_end")), ["tree_id", "anc"], "left").select(*KEY, "anc", "steps", "length", F.coalesce("_end", F.lit(False)).alias("_end")))
    while reach.where(~F.col("_end")).take(1):
        onward = reach.select("tree_id", F.col("node").alias("anc"), F.col("anc").alias("_anc"), F.col("steps").alias("_steps"), F.col("length").alias("_length"), F.col("_end").alias("_done"))
        further = reach.where(~F.col("_end")).join(onward, ["tree_id", "anc"]).select(
            *KEY, F.col("_anc").alias("anc"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("length") + F.col("_length")).alias("length"), F.col("_done").alias("_end")
        )
        reach = cut_lineage(reach.where("_end").unionByName(further))
    return reach.drop("_end")


def tree_depths(edges: DataFrame) -> DataFrame:
    """Level and path length from the root for every node."""
    own = roots(edges).select(*KEY, F.lit(0).cast("long").alias("level"), F.lit(0.0).alias("depth"))
    return nearest_above(edges).select(*KEY, F.col("steps").alias("level"), F.col("length").alias("depth")).unionByName(own)


def jumps(edges: DataFrame) -> list[DataFrame]:
    """Jump pointers: entry k holds node, anc with ``anc`` 2**k steps above (stored, one row per node that has one)."""
    found = [cut_lineage(edges.select("tree_id", F.col("child").alias("node"), F.col("parent").alias("anc")))]
    while True:
        last = found[-1]
        far = cut_lineage(last.join(last.select("tree_id", F.col("node").alias("anc"), F.col("anc").alias("_far")), ["tree_id", "anc"]).select(*KEY, F.col("_far").alias("anc")))
        if not far.take(1):
            return found
        found.append(far)


def subtree_sums(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """node, total: sum of ``weights`` (tree_id, node, w) over the node and all its descendants.

    After round k a total covers descendants fewer than 2**k steps below; those at
    exactly 2**k steps bring the next as many.
    """
    given = weights.groupBy(*KEY).agg(F.sum("w").alias("total"))
    total = cut_lineage(nodes(edges).join(given, KEY, "left").select(*KEY, F.coalesce("total", F.lit(0)).alias("total")))
    for level in jumps(edges):
        gain = level.join(total.where("total <> 0"), KEY).groupBy("tree_id", F.col("anc").alias("node")).agg(F.sum("total").alias("_gain"))
        total = cut_lineage(total.join(gain, KEY, "left").select(*KEY, (F.col("total") + F.coalesce("_gain", F.lit(0))).alias("total")))
    return total


def patristic_distance(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Most recent common ancestor and path length for pairs ``(tree_id, a, b)``; pairs with an unknown node are left out.

    The deeper node is lifted to the level of the other, then both are lifted
    while their ancestors differ: two joins per power of two of the depth.  Pairs
    meet on few nodes near the root, so those of one node are salted.
    """
    table = jumps(edges)
    depth = cut_lineage(tree_depths(edges))
    side = lambda n: depth.select("tree_id", F.col("node").alias(n), F.col("level").alias(f"_l{n}"), F.col("depth").alias(f"_d{n}"))

    def onto(left: DataFrame, right: DataFrame, node: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
        """``left`` joined to ``right`` on a node; ``counted``: stored rows that hold the node as often."""
        keys = ["tree_id", node]
        if few:
            return left.join(right, keys, how)
        return skew.salted_join(left, right, keys, ["a", "b"], HOT_PAIRS, how, skew.hot_keys(left if counted is None else counted, keys, HOT_PAIRS))

    given = cut_lineage(pairs.select("tree_id", "a", "b").distinct())
    few = given.count() <= HOT_PAIRS
    known = onto(onto(given, side("a"), "a"), side("b"), "b", counted=given)
    deep = F.col("_la") >= F.col("_lb")
    now = cut_lineage(known.select(
        "tree_id", "a", "b", (F.col("_da") + F.col("_db")).alias("_sum"), F.when(deep, F.col("a")).otherwise(F.col("b")).alias("_u"),
        F.when(deep, F.col("b")).otherwise(F.col("a")).alias("_v"), F.abs(F.col("_la") - F.col("_lb")).alias("_gap"),
    ))
    up = lambda k, n: table[k].select("tree_id", F.col("node").alias(n), F.col("anc").alias(f"{n}_up"))
    for k in reversed(range(len(table))):
        bit = F.col("_gap").bitwiseAND(1 << k) > 0
        lifted = onto(now.where(bit), up(k, "_u"), "_u").withColumn("_u", F.col("_u_up")).select(*now.columns)
        now = cut_lineage(now.where(~bit).unionByName(lifted))
    for k in reversed(range(len(table))):
        apart = now.where("_u <> _v")
        far = onto(onto(apart, up(k, "_u"), "_u", "left"), up(k, "_v"), "_v", "left", counted=apart)
        move = F.coalesce(F.col("_u_up") != F.col("_v_up"), F.lit(False))
        far = far.withColumns({"_u": F.when(move, F.col("_u_up")).otherwise(F.col("_u")), "_v": F.when(move, F.col("_v_up")).otherwise(F.col("_v"))}).select(*now.columns)
        now = cut_lineage(now.where("_u = _v").unionByName(far))
    met = onto(now, up(0, "_u"), "_u", "left").select("tree_id", "a", "b", "_sum", F.when(F.col("_u") == F.col("_v"), F.col("_u")).otherwise(F.col("_u_up")).alias("mrca"))
    met = met if few else cut_lineage(met)
    top = depth.select("tree_id", F.col("node").alias("mrca"), F.col("depth").alias("_top"))
    return onto(met, top, "mrca").select("tree_id", "a", "b", "mrca", (F.col("_sum") - 2 * F.col("_top")).alias("distance"))


def prune(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Keep the given nodes ``(tree_id, node)`` and join edges through unary nodes.

    The root stays even when one branch is left.
    """
    wanted = keep.select(*KEY).distinct()
    alive = subtree_sums(edges, wanted.withColumn("w", F.lit(1).cast("long"))).where("total > 0").select("tree_id", F.col("node").alias("child"))
    kept = cut_lineage(edges.join(alive, ["tree_id", "child"], "left_semi"))
    forks = kept.groupBy("tree_id", "parent").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("tree_id", F.col("parent").alias("node"))
    stops = wanted.unionByName(forks).distinct()
    return nearest_above(kept, stops).join(stops, KEY, "left_semi").select("tree_id", F.col("node").alias("child"), F.col("anc").alias("parent"), F.col("length").alias("blen"))


def root_path(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes on the way from ``ends`` (tree_id, node; one per tree) to the root, both included."""
    return subtree_sums(edges, ends.select(*KEY).withColumn("w", F.lit(1).cast("long"))).where("total > 0").select(*KEY)


def _turned(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges with those on the root path of ``ends`` turned, which makes these nodes the roots."""
    path = root_path(edges, ends).select("tree_id", F.col("node").alias("child"), F.lit(True).alias("_turn"))
    turn = F.coalesce("_turn", F.lit(False))
    return edges.join(path, ["tree_id", "child"], "left").select(
        "tree_id", F.when(turn, F.col("parent")).otherwise(F.col("child")).alias("child"), F.when(turn, F.col("child")).otherwise(F.col("parent")).alias("parent"), "blen"
    )


def reroot(edges: DataFrame, outgroup: str) -> DataFrame:
    """Make ``outgroup`` the root by turning the edges on its root path."""
    return _turned(edges, edges.where(F.col("child") == F.lit(outgroup)).select("tree_id", F.col("child").alias("node")))


def midpoint_path(edges: DataFrame) -> DataFrame:
    """The longest leaf-to-leaf path of every tree: a, b, their lengths up to the common ancestor ``mrca``, its depth.

    ``a`` is the leaf farthest from the root, ``b`` the one farthest from ``a`` (the
    root counts as a leaf if it has one child); the smaller name wins a tie.
    """
    depth = cut_lineage(tree_depths(edges))
    lone = edges.groupBy("tree_id", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").join(roots(edges), KEY, "left_semi")
    leaves = terminals(edges).select("tree_id", F.col("child").alias("node")).unionByName(lone.select(*KEY))
    far = lambda by: F.min(F.struct((-F.col(by)).alias("d"), "node"))["node"]
    a = cut_lineage(depth.join(leaves, KEY, "left_semi").groupBy("tree_id").agg(far("depth").alias("node")))
    path = cut_lineage(root_path(edges, a))
    # the common ancestor with a is the nearest node on a's path, a node of the path itself included
    onto = nearest_above(edges, path).select(*KEY, "anc").join(path, KEY, "left_anti").unionByName(path.withColumn("anc", F.col("node")))
    tops = depth.select("tree_id", F.col("node").alias("anc"), F.col("depth").alias("_top"))
    ends = a.join(depth, KEY).select("tree_id", F.col("node").alias("a"), F.col("depth").alias("_da"))
    apart = onto.join(leaves, KEY, "left_semi").join(depth, KEY).join(tops, ["tree_id", "anc"]).join(ends, "tree_id").where("node <> a")
    best = F.min(F.struct((2 * F.col("_top") - F.col("depth") - F.col("_da")).alias("d"), "node", "anc", "depth", "_top", "_da"))
    return apart.groupBy("tree_id", "a").agg(best.alias("m")).select(
        "tree_id", "a", F.col("m.node").alias("b"), F.col("m.anc").alias("mrca"), (F.col("m._da") - F.col("m._top")).alias("length_a"),
        (F.col("m.depth") - F.col("m._top")).alias("length_b"), F.col("m._top").alias("mrca_depth"),
    )


def midpoint_node(edges: DataFrame) -> DataFrame:
    """The two ends of the longest leaf-to-leaf path of every tree and half its length."""
    return midpoint_path(edges).select("tree_id", "a", "b", ((F.col("length_a") + F.col("length_b")) / 2).alias("half_distance"))


def midpoint_reroot(edges: DataFrame, name: str = "midpoint") -> DataFrame:
    """The same trees rooted halfway along their longest leaf-to-leaf path, as edges.

    The edge that holds the midpoint is cut by a new root called ``name``; a
    midpoint on a node makes that node the root.  The former root, if one child is
    left to it, is joined through.  Trees need non-negative lengths.
    """
    ends = cut_lineage(midpoint_path(edges))
    depth = cut_lineage(tree_depths(edges))
    # the midpoint lies above the end that is farther from the common ancestor
    long_a = F.col("length_a") >= F.col("length_b")
    half = (F.col("length_a") + F.col("length_b")) / 2
    spot = ends.select("tree_id", F.when(long_a, F.col("a")).otherwise(F.col("b")).alias("node"), (F.col("mrca_depth") + F.greatest("length_a", "length_b") - half).alias("_at"))
    level = lambda n: depth.select("tree_id", F.col("node").alias(n), F.col("depth").alias(f"_{n}"))
    path = root_path(edges, spot).select("tree_id", F.col("node").alias("child"))
    on_path = edges.join(path, ["tree_id", "child"], "left_semi").join(level("child"), ["tree_id", "child"]).join(level("parent"), ["tree_id", "parent"])
    cut = on_path.join(spot.select("tree_id", "_at"), "tree_id").where("_parent <= _at and _at < _child")
    cut = cut_lineage(cut.select("tree_id", "child", "parent", (F.col("_child") - F.col("_at")).alias("_below"), (F.col("_at") - F.col("_parent")).alias("_above")))
    split = cut.where("_above > 0")
    new = split.select("tree_id", "child", F.lit(name).alias("parent"), F.col("_below").alias("blen")).unionByName(
        split.select("tree_id", F.lit(name).alias("child"), "parent", F.col("_above").alias("blen"))
    )
    grown = edges.join(split.select("tree_id", "child"), ["tree_id", "child"], "left_anti").select("tree_id", "child", "parent", F.col("blen").cast("double").alias("blen")).unionByName(new)
    top = split.select("tree_id", F.lit(name).alias("node")).unionByName(cut.where("_above = 0").select("tree_id", F.col("parent").alias("node")))
    return _without_unary(cut_lineage(_turned(cut_lineage(grown), top)), roots(edges).join(top, KEY, "left_anti"))


def _without_unary(edges: DataFrame, old: DataFrame) -> DataFrame:
    """Join the edges through those ``old`` nodes (one per tree) that have a parent and one child."""
    one = edges.groupBy("tree_id", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("child").alias("_child"), F.min("blen").alias("_low")).where("_n = 1")
    through = edges.select("tree_id", F.col("child").alias("node"), "parent", "blen").join(old, KEY, "left_semi").join(one, KEY)
    through = cut_lineage(through.select("tree_id", "node", F.col("_child").alias("child"), "parent", (F.col("blen") + F.col("_low")).alias("blen")))
    gone = through.select("tree_id", "child").unionByName(through.select("tree_id", F.col("node").alias("child")))
    return edges.join(gone, ["tree_id", "child"], "left_anti").unionByName(through.drop("node"))

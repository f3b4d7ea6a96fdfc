"""Tree operators against plain walks, on random trees, forests and a deep chain."""

import random
from collections import defaultdict

import pytest

from strandframe.operators import phylogeny as P

EDGE = "tree_id string, child string, parent string, blen double"


def random_tree(name, n, rng, deep):
    out = []
    for i in range(1, n):
        parent = rng.randint(max(0, i - 3), i - 1) if deep else rng.randint(0, i - 1)
        out.append((name, f"v{i}", f"v{parent}", rng.randint(1, 16) / 4))
    return out


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(6)
    rows = random_tree("a", 70, rng, True) + random_tree("b", 60, rng, False) + [("c", "v1", "v0", 2.0)] + [("d", f"v{i}", "v0", 1.0) for i in range(1, 5)]
    return rows, spark.createDataFrame(rows, EDGE).repartition(4)


def by_tree(rows):
    out = defaultdict(dict)
    for t, c, p, b in rows:
        out[t][c] = (p, b)
    return out


def path(up, v):
    out = [(v, 0.0)]
    while v in up:
        v, b = up[v]
        out.append((v, out[-1][1] + b))
    return out


def meet(up, a, b):
    over = dict(path(up, b))
    return next((v, d + over[v]) for v, d in path(up, a) if v in over)


def distances(rows):
    """All pairs of nodes of one tree, whatever its root."""
    near = defaultdict(list)
    for _, c, p, b in rows:
        near[c].append((p, b))
        near[p].append((c, b))
    out = {}
    for s in near:
        todo, out[s, s] = [s], 0.0
        while todo:
            v = todo.pop()
            for w, b in near[v]:
                if (s, w) not in out:
                    out[s, w] = out[s, v] + b
                    todo.append(w)
    return out


def test_depths_and_distances(spark, forest):
    rows, edges = forest
    trees = by_tree(rows)
    found = {(r.tree_id, r.node): (r.level, r.depth) for r in P.tree_depths(edges).collect()}
    want = {(t, v): (len(path(up, v)) - 1, path(up, v)[-1][1]) for t, up in trees.items() for v in {*up, "v0"}}
    assert found == want
    rng = random.Random(1)
    pairs = [(t, rng.choice(list(up)), rng.choice([*up, "v0"])) for t, up in trees.items() for _ in range(120)]
    got = {(r.tree_id, r.a, r.b): (r.mrca, r.distance) for r in P.patristic_distance(edges, spark.createDataFrame([*pairs, ("a", "v1", "gone")], "tree_id string, a string, b string")).collect()}
    assert got.keys() == set(pairs)
    for t, a, b in pairs:
        node, length = meet(trees[t], a, b)
        assert got[t, a, b] == (node, pytest.approx(length))


def test_subtree_sums(spark, forest):
    rows, edges = forest
    weights = [(t, c, i % 5) for i, (t, c, _, _) in enumerate(rows)] + [("a", "v3", 7), ("b", "v0", 2)]
    want = defaultdict(int)
    for t, v, w in weights:
        for u, _ in path(by_tree(rows)[t], v):
            want[t, u] += w
    got = {(r.tree_id, r.node): r.total for r in P.subtree_sums(edges, spark.createDataFrame(weights, "tree_id string, node string, w long")).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_prune_keeps_distances(spark, forest):
    rows, edges = forest
    keep = [("a", "v60"), ("a", "v69"), ("a", "v40"), ("b", "v55"), ("b", "v1"), ("d", "v2"), ("a", "gone")]
    got = [tuple(r) for r in P.prune(edges, spark.createDataFrame(keep, "tree_id string, node string")).select("tree_id", "child", "parent", "blen").collect()]
    assert {t for t, *_ in got} == {"a", "b", "d"}
    for t in "abd":
        full, part = distances([r for r in rows if r[0] == t]), distances([r for r in got if r[0] == t])
        assert all(part[k] == pytest.approx(full[k]) for k in part)
        wanted = {v for u, v in keep if u == t and v != "gone"}
        held = {v for v, _ in part}
        assert wanted <= held
        fork = defaultdict(int)
        for u, _, p, _ in got:
            fork[p] += u == t
        assert all(v in wanted or v == "v0" or fork[v] > 1 for v in held)


def test_reroot_and_midpoint(spark, forest):
    rows, edges = forest
    turned = [tuple(r) for r in P.reroot(edges, "v4").select("tree_id", "child", "parent", "blen").collect()]
    for t in "abd":
        up = {c: (p, b) for u, c, p, b in turned if u == t}
        assert "v4" not in up and all(path(up, v)[-1][0] == "v4" for v in up)
        assert distances([r for r in turned if r[0] == t]) == distances([r for r in rows if r[0] == t])
    middle = [tuple(r) for r in P.midpoint_reroot(edges).select("tree_id", "child", "parent", "blen").collect()]
    halves = {r.tree_id: r for r in P.midpoint_node(edges).collect()}
    for t in "abcd":
        mine, given = [r for r in middle if r[0] == t], [r for r in rows if r[0] == t]
        up = {c: (p, b) for _, c, p, b in mine}
        assert len(up) == len(mine)
        (top,) = {p for p, _ in up.values()} - set(up)
        before, after = distances(given), distances(mine)
        leaves = {c for _, c, _, _ in given} - {p for _, _, p, _ in given}
        assert all(after[a, b] == pytest.approx(before[a, b]) for a in leaves for b in leaves)
        ends = leaves | ({"v0"} if sum(p == "v0" for _, _, p, _ in given) == 1 else set())
        longest = max(before[a, b] for a in ends for b in ends)
        assert halves[t].half_distance == pytest.approx(longest / 2)
        depths = sorted((after[top, v] for v in ends if (top, v) in after), reverse=True)
        assert depths[0] == pytest.approx(longest / 2) and depths[1] == pytest.approx(longest / 2)


def test_empty_and_star(spark):
    none = spark.createDataFrame([], EDGE)
    assert P.tree_depths(none).count() == 0 and P.prune(none, none.selectExpr("tree_id", "child as node")).count() == 0 and P.midpoint_reroot(none).count() == 0


def test_chain_of_100000_nodes(spark):
    n = 100_000
    edges = spark.range(1, n).selectExpr("'t' as tree_id", "concat('v', id) as child", "concat('v', id - 1) as parent", "1.0D as blen")
    deepest = P.tree_depths(edges).orderBy("level", ascending=False).first()
    assert (deepest.node, deepest.level, deepest.depth) == (f"v{n - 1}", n - 1, n - 1.0)
    pairs = spark.createDataFrame([("t", "v99999", "v12345"), ("t", "v7", "v7")], "tree_id string, a string, b string")
    assert {(r.a, r.mrca, r.distance) for r in P.patristic_distance(edges, pairs).collect()} == {("v99999", "v12345", 87654.0), ("v7", "v7", 0.0)}


def test_prune_of_a_chain(spark):
    edges = spark.range(1, 3000).selectExpr("'t' as tree_id", "concat('v', id) as child", "concat('v', id - 1) as parent", "1.0D as blen")
    kept = P.prune(edges, spark.createDataFrame([("t", "v2999"), ("t", "v1500")], "tree_id string, node string"))
    assert {(r.child, r.parent, r.blen) for r in kept.collect()} == {("v2999", "v1500", 1499.0), ("v1500", "v0", 1500.0)}


def test_patristic_distance_spreads_hot_nodes(spark, monkeypatch):
    """Nearly all pairs meet at one node; their joins still deal them over the tasks."""
    monkeypatch.setattr(P, "HOT_PAIRS", 200, raising=False)
    edges = [("t", f"r{k}", "root", 1.0) for k in range(3)] + [("t", f"c{k}", f"r{k % 3}", 2.0) for k in range(300)]
    pairs = [("t", f"c{k % 300}", f"c{(k * 7 + k // 300) % 300}") for k in range(6000)]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        found = P.patristic_distance(spark.createDataFrame(edges, "tree_id string, child string, parent string, blen double"), spark.createDataFrame(pairs, "tree_id string, a string, b string"))
        parts = [len(p) for p in found.rdd.glom().collect()]
        got = {(r.a, r.b): (r.mrca, r.distance) for r in found.collect()}
    finally:
        for key in conf:
            spark.conf.unset(key)
    group = lambda c: int(c[1:]) % 3
    want = {(a, b): (a, 0.0) if a == b else (f"r{group(a)}", 4.0) if group(a) == group(b) else ("root", 6.0) for _, a, b in pairs}
    assert got == want and sum(parts) == len(want)
    assert max(parts) < len(want) / 2

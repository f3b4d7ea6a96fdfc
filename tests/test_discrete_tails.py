"""Hypergeometric and Fisher tails, ranked enrichment and the chosen group test."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions.discrete import Drawn, hyper_upper
from strandframe.operators import enrichment, hypothesis


def chances(n, marked, whole):
    return {k: Fraction(math.comb(marked, k) * math.comb(whole - marked, n - k), math.comb(whole, n)) for k in range(max(0, n + marked - whole), min(n, marked) + 1)}


def test_tails_of_small_counts():
    rng = random.Random(3)
    for _ in range(400):
        whole = rng.randint(1, rng.choice([3, 20, 300]))
        marked, n = rng.randint(0, whole), rng.randint(0, whole)
        p = chances(n, marked, whole)
        x = rng.choice(list(p))
        d = Drawn([n], [marked], [whole])
        assert d.upper([x])[0] == pytest.approx(float(sum(v for k, v in p.items() if k >= x)), rel=1e-9)
        assert d.two_sided([x])[0] == pytest.approx(float(sum(v for v in p.values() if v <= p[x] * (1 + Fraction(1, 10**7)))), rel=1e-9)
        assert d.upper([min(p) - 1])[0] == 1 and d.upper([max(p) + 1])[0] == 0


def test_tails_of_huge_counts():
    """Counts of 1e9: the normal limit near the middle, an exact geometric end far out."""
    d = Drawn([5e8], [4e8], [1e9])
    sd = math.sqrt(5e8 * 0.4 * 0.6 * 0.5)
    for z in (0.5, 3.0):
        assert d.upper([round(2e8 + z * sd)])[0] == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-3)
        assert d.two_sided([round(2e8 - z * sd)])[0] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)
    assert d.upper([3e8])[0] == 0 and d.upper([1e8])[0] == 1


def test_columns_with_nulls(spark):
    rows = [(3, 10, 5, 40), (None, 10, 5, 40), (0, 0, 0, 1), (200_000_000, 500_000_000, 400_000_000, 1_000_000_000)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long, c long, d long").select(hyper_upper(*[F.col(c) for c in "abcd"])).collect()]
    assert got[0] == pytest.approx(float(sum(v for k, v in chances(10, 5, 40).items() if k >= 3))) and got[1] is None and got[2] == 1 and got[3] == pytest.approx(0.5, abs=1e-3)
    tables = spark.createDataFrame([(8, 2, 1, 5), (0, 0, 0, 0), (10**9, 10**9, 10**9, 10**9 + 10**6)], "a long, b long, c long, d long")
    p = {r.a: r for r in hypothesis.fisher_exact(tables).collect()}
    assert p[8].p == pytest.approx(0.03496503, rel=1e-6) and p[8].odds_ratio == 20
    assert p[0].odds_ratio is None and p[0].p == 1 and 0 < p[10**9].p < 1


def naive_scores(order, weights, members):
    hit = np.array([g in members for g in order])
    w = np.array([abs(weights[g]) for g in order]) * hit
    run = np.cumsum(w / w.sum() - (~hit) / (~hit).sum())
    before = run - w / w.sum()
    top, low = run[hit].max(), before[hit].min()
    at = np.flatnonzero(hit)
    if top >= -low:
        peak = at[run[hit].argmax()]
        return top, [g for g in order[: peak + 1] if g in members]
    peak = at[before[hit].argmin()]
    return low, [g for g in order[peak:] if g in members]


def test_gsea_against_a_plain_walk(spark):
    rng = random.Random(12)
    stats = {f"g{i:03d}": rng.gauss(0, 2) for i in range(300)}
    order = sorted(stats, key=lambda g: (-stats[g], g))
    sets = {f"s{k}": set(rng.sample(order, rng.choice([15, 22, 40]))) for k in range(9)} | {"top": set(order[:20]), "end": set(order[-18:]), "few": set(order[:3])}
    ranks = spark.createDataFrame([*stats.items(), ("none", None)], "gene string, stat double")
    members = spark.createDataFrame([(s, g) for s, m in sets.items() for g in m] + [("s0", "absent")], "gs_name string, gene string")
    deal = lambda gene, perm: F.conv(F.substring(F.md5(F.concat(gene, perm.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    found = {r.gs_name: r for r in enrichment.gsea(ranks, members, n_perm=40, shuffle=deal).collect()}
    assert found.keys() == set(sets) - {"few"}
    import hashlib

    null = {}
    for perm in range(1, 41):
        dealt = sorted(order, key=lambda g: (hashlib.md5(f"{g}{perm}".encode()).hexdigest()[:15], g))
        for k in {len(m) for m in sets.values()}:
            if k >= 15:
                null.setdefault(k, []).append(naive_scores(order, stats, set(dealt[:k]))[0])
    for name, r in found.items():
        es, edge = naive_scores(order, stats, sets[name])
        assert r.es == pytest.approx(es) and r.leading_genes == edge and r.leading_edge == len(edge) and r.size == len(sets[name])
        same = [e for e in null[r.size] if (e >= 0) == (es >= 0)]
        if same:
            assert r.pval == pytest.approx((sum(abs(e) >= abs(es) for e in same) + 1) / (len(same) + 1)) and r.nes == pytest.approx(es / np.mean(np.abs(same)))
        else:
            assert r.pval is None and r.nes is None and r.padj is None


def test_permutations_that_fall_short_draw_again(spark):
    """A hash that leaves most genes far up still gives every permutation its genes."""
    placed = spark.range(1, 401).selectExpr("concat('g', id) as gene", "id as position", "cast(id as double) as stat")
    lumpy = lambda gene, perm: F.pmod(F.xxhash64(gene, perm), F.lit(1 << 40)) + F.lit((1 << 60) - (1 << 41))
    got = enrichment._drawn(placed, 400, 30, 5, lumpy).groupBy("perm").count().collect()
    assert sorted((r["perm"], r["count"]) for r in got) == [(p, 30) for p in range(1, 6)]


def test_group_test_report(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(5, 1)) for _ in range(40)] + [("b", rng.gauss(6, 1)) for _ in range(30)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for test in ("ttest", "mannwhitney"):
        r = hypothesis.stats_test(df, "g", "v", test=test).first()
        a, b = (np.array([v for g, v in rows if g == x]) for x in "ab")
        assert r.effect_size == pytest.approx((a.mean() - b.mean()) / np.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2))
        assert [(s["group"], s["n"]) for s in r.group_stats] == [("a", 40), ("b", 30)] and r.group_stats[0]["median"] == pytest.approx(np.median(a))
        assert (r.n_groups, r.n_total) == (2, 71)
    chi = hypothesis.stats_test(spark.createDataFrame([("x", "u"), ("x", "v"), ("y", "u"), ("y", "u")], "g string, v string"), "g", "v", test="chi2").first()
    assert chi.effect_size is None and chi.group_stats is None and chi.n_groups == 2
    with pytest.raises(ValueError):
        hypothesis.stats_test(df, "g", "v", test="other")

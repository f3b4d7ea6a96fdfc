"""Distributions, ordered scans, survival, enrichment and fits against plain Python."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import distributions as D
from strandframe.operators import alignment, enrichment, expression, hypothesis, microbiome, pairwise, phylogeny, structure, survival
from strandframe.plans import scan


def value(spark, col):
    return spark.range(1).select(col).first()[0]


def test_tails_against_known_values(spark):
    assert value(spark, D.normal_two_sided(1.959963984540054)) == pytest.approx(0.05, abs=1e-10)
    assert value(spark, D.t_two_sided(2.228138852, 10)) == pytest.approx(0.05, abs=1e-8)
    assert value(spark, D.chi2_upper(3.841458820694124, 1)) == pytest.approx(0.05, abs=1e-10)
    assert value(spark, D.chi2_upper(18.307038053275146, 10)) == pytest.approx(0.05, abs=1e-10)
    assert value(spark, D.f_upper(4.964602743730711, 1, 10)) == pytest.approx(0.05, abs=1e-8)
    assert value(spark, D.normal_quantile(0.975)) == pytest.approx(1.959963984540054, abs=1e-7)
    assert value(spark, D.ln_gamma(10.5)) == pytest.approx(math.lgamma(10.5), abs=1e-10)


def test_tails_against_the_jvm_library(spark):
    beta = spark._jvm.org.apache.commons.math3.special.Beta
    gamma = spark._jvm.org.apache.commons.math3.special.Gamma
    for a, b, x in [(0.5, 0.5, 0.3), (2.0, 7.5, 0.9), (150.0, 0.5, 0.97), (4000.0, 3000.0, 0.57)]:
        assert value(spark, D.beta_inc(a, b, x)) == pytest.approx(beta.regularizedBeta(x, a, b), rel=1e-8)
    for a, x in [(0.5, 0.2), (0.5, 6.0), (5.0, 3.0), (40.0, 60.0)]:
        assert value(spark, D.gamma_upper(a, x)) == pytest.approx(gamma.regularizedGammaQ(a, x), rel=1e-8)


@pytest.fixture(scope="module")
def skewed(spark):
    """Two groups; one value fills a third of the rows."""
    rnd = random.Random(7)
    rows = [("a" if rnd.random() < 0.8 else "b", 5.0 if rnd.random() < 0.33 else round(rnd.gauss(0, 3), 2)) for _ in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, v double")


def test_exact_quantiles(spark, skewed):
    rows, df = skewed
    got = {r["g"]: r for r in scan.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "med": 0.5, "p9": 0.9}, 32).collect()}
    for g in "ab":
        v = np.array([x for k, x in rows if k == g])
        for name, p in (("q1", 25), ("med", 50), ("p9", 90)):
            assert got[g][name] == pytest.approx(np.percentile(v, p))


def test_midranks_and_positions(spark, skewed):
    rows, df = skewed
    v = sorted(x for _, x in rows)
    got = {r["v"]: r["midrank"] for r in scan.midranks(df, [], "v").collect()}
    assert all(got[x] == v.index(x) + (v.count(x) + 1) / 2 for x in set(v))
    ids = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r["k"] + 1 == r["position"] for r in scan.row_positions(ids, [F.asc("k")]).collect())


def test_bh_is_monotone_and_right(spark):
    rnd = random.Random(4)
    ps = [round(rnd.random() ** 3, 4) for _ in range(500)] + [1.0] * 200
    q = {r["i"]: (r["p"], r["q"]) for r in hypothesis.bh_fdr(spark.createDataFrame(list(enumerate(ps)), "i int, p double")).collect()}
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    best, want = 1.0, {}
    for rank in range(len(ps), 0, -1):
        i = order[rank - 1]
        best = min(best, ps[i] * len(ps) / rank)
        want[i] = best
    assert all(q[i][1] == pytest.approx(want[i]) for i in want)


def test_exact_mann_whitney(spark):
    a, b = [1.1, 2.2, 3.3, 10.5], [0.5, 4.4, 5.5, 6.6, 7.7]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double")
    r = hypothesis.mann_whitney(df, "g", "v", "a", "b", exact=True).first()
    u = sum(x > y for x in a for y in b)
    from itertools import combinations

    pool = sorted(a + b)
    us = [sum(x > y for x in c for y in pool if y not in c) for c in combinations(pool, 4)]
    top = max(u, 20 - u)
    assert r["u"] == u and r["p"] == pytest.approx(min(1, 2 * sum(x >= top for x in us) / len(us)))


def test_stats_test_choices(spark):
    rnd = random.Random(0)
    normal = [("x", rnd.gauss(0, 1)) for _ in range(60)] + [("y", rnd.gauss(1, 1)) for _ in range(60)]
    heavy = [("x", math.exp(rnd.gauss(0, 2))) for _ in range(60)] + [("y", math.exp(rnd.gauss(0, 2))) for _ in range(60)]
    run = lambda rows: hypothesis.stats_test(spark.createDataFrame(rows, "g string, v double"), "g", "v").first()["test"]
    assert run(normal) == "Independent t-test" and run(heavy) == "Mann-Whitney U"
    assert run(normal + [("z", rnd.gauss(0, 1)) for _ in range(30)]) == "One-way ANOVA"
    with pytest.raises(ValueError):
        run([("x", 1.0)] * 5)


def test_shapiro_on_quantiles(spark):
    nd = statistics.NormalDist()
    rows = [("n", i, nd.inv_cdf((i - 0.375) / 100.25)) for i in range(1, 101)] + [("e", i, math.exp(i / 15)) for i in range(1, 101)]
    got = {r["g"]: r for r in hypothesis.shapiro(spark.createDataFrame(rows, "g string, o int, v double"), "g", "v", "o").collect()}
    assert got["n"]["w"] > 0.99 and got["n"]["p"] > 0.9 and got["e"]["p"] < 1e-6


def test_survival_curve_never_rises(spark):
    rnd = random.Random(2)
    rows = [("a", rnd.randint(1, 40), rnd.randint(0, 1)) for _ in range(300)] + [("b", 5, 1), ("b", 9, 1)]
    curve = survival.kaplan_meier(spark.createDataFrame(rows, "g string, time int, event int"), "g").orderBy("g", "time").collect()
    for g in "ab":
        s = [r["survival"] for r in curve if r["g"] == g]
        assert all(x >= y - 1e-12 for x, y in zip(s, s[1:]))
    assert [r["survival"] for r in curve if r["g"] == "b"] == [pytest.approx(0.5), 0.0]


def test_concordance_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(1, 15), rnd.randint(0, 1), float(rnd.randint(0, 6))) for _ in range(150)]
    r = survival.concordance_index(spark.createDataFrame(rows, "time int, event int, risk double"), "risk").first()
    con = tie = comp = 0
    for t, e, k in rows:
        for t2, e2, k2 in rows:
            if e == 1 and (t < t2 or (t == t2 and e2 == 0)):
                comp += 1
                con += k > k2
                tie += k == k2
    assert (r["concordant"], r["tied"], r["comparable"]) == (con, tie, comp)


def test_cox_finds_the_effect(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=800)
    t = np.ceil(rng.exponential(np.exp(-0.8 * x)) * 100).astype(int) + 1
    df = spark.createDataFrame([(int(a), 1, float(b)) for a, b in zip(t, x)], "time int, event int, x double")
    row = survival.cox_ph(df, ["x"], penalizer=0.0).first()
    assert row["coef"] == pytest.approx(0.8, abs=0.12) and row["p"] < 1e-10 and row["ci_low"] < row["hazard_ratio"] < row["ci_high"]


def test_empty_gene_list_is_an_error(spark):
    genes = spark.createDataFrame([], "gene int")
    sets = spark.createDataFrame([("s", 1)], "gs_name string, gene int")
    with pytest.raises(ValueError):
        enrichment.ora(genes, sets, sets.select("gene"))


def test_gsea_permutations(spark):
    ranks = spark.createDataFrame([(i, float(200 - i)) for i in range(400)], "gene int, stat double")
    sets = spark.createDataFrame([("up", i) for i in range(20)] + [("mixed", i) for i in range(0, 400, 20)], "gs_name string, gene int")
    r = {x["gs_name"]: x for x in enrichment.gsea(ranks, sets, 10, 100, n_perm=50).collect()}
    assert r["up"]["es"] > 0.9 and r["up"]["pval"] < 0.1 and r["up"]["nes"] > 1 and abs(r["mixed"]["es"]) < r["up"]["es"]
    assert all(0 < x["pval"] <= 1 and x["padj"] >= x["pval"] - 1e-12 for x in r.values())


def test_pcoa_rebuilds_distances(spark):
    pts = {0: (0.0, 0.0), 1: (3.0, 0.0), 2: (0.0, 4.0), 3: (6.0, 1.0)}
    rows = [(a, b, math.dist(pts[a], pts[b])) for a in pts for b in pts if a < b]
    got = microbiome.pcoa(spark.createDataFrame(rows, "a int, b int, distance double"), 2).collect()
    place = {}
    for r in got:
        place.setdefault(r["sample"], {})[r["axis"]] = r["coordinate"]
    for a, b, d in rows:
        assert math.dist(place[a].values(), place[b].values()) == pytest.approx(d, abs=1e-6)
    assert sum({r["axis"]: r["explained"] for r in got}.values()) == pytest.approx(1.0)


def test_superposition(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 3))
    c, s = math.cos(0.7), math.sin(0.7)
    b = a @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) + [5, -2, 1]
    rows = [(k, "A", i, "ALA", "CA", *map(float, p)) for k, m in ((1, a), (2, b)) for i, p in enumerate(m)]
    atoms = spark.createDataFrame(rows, "struct_id long, chain string, resseq int, resname string, atom string, x double, y double, z double")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    row = structure.superpose_rmsd(atoms, pairs).first()
    assert row["rmsd"] == pytest.approx(0, abs=1e-6) and row["n_atoms"] == 12
    turn = np.array(row["rotation"]).reshape(3, 3)
    assert np.allclose(b @ turn.T + row["translation"], a, atol=1e-6)


def naive_align(s, t, mode, match=2, mismatch=-1, gap=-5, more=-2):
    n, m = len(s), len(t)
    low = -1e9
    H = [[low] * (m + 1) for _ in range(n + 1)]
    E = [[low] * (m + 1) for _ in range(n + 1)]
    G = [[low] * (m + 1) for _ in range(n + 1)]
    best = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 and j == 0:
                H[i][j] = 0
                continue
            if i == 0 or j == 0:
                H[i][j] = 0 if mode == "local" else gap + (i + j - 1) * more
                continue
            E[i][j] = max(H[i][j - 1] + gap, E[i][j - 1] + more)
            G[i][j] = max(H[i - 1][j] + gap, G[i - 1][j] + more)
            H[i][j] = max(H[i - 1][j - 1] + (match if s[i - 1] == t[j - 1] else mismatch), E[i][j], G[i][j])
            if mode == "local":
                H[i][j] = max(H[i][j], 0)
                best = max(best, H[i][j])
    return best if mode == "local" else H[n][m]


@pytest.mark.parametrize("mode", ["global", "local"])
def test_alignment_scores(spark, mode):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 25)))
    rows = [(i, word(), word()) for i in range(60)] + [(60, "ATGAAACGCATTAGCACC", "ATGAAACGTATTAGCACT")]
    got = {r["pair_id"]: r["score"] for r in alignment.pairwise_align(spark.createDataFrame(rows, "pair_id int, a string, b string"), mode).collect()}
    assert all(got[i] == naive_align(a, b, mode) for i, a, b in rows)


@pytest.mark.parametrize("mode", ["global", "local"])
def test_alignment_texts(spark, mode):
    """Small cell budgets divide every pair; the path always adds up to the best score."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 30)))
    rows = [(i, word(), word()) for i in range(60)] + [(60, None, "AC"), (61, "", ""), (62, None, None), (63, "été 😀", "ete 😀"), (64, "ACGT" * 40, "T" + "ACGT" * 40)]
    pairs = spark.createDataFrame(rows, "pair_id int, a string, b string").repartition(3)
    for cells in (12, 200, 1 << 25):
        found = {r["pair_id"]: r for r in alignment.pairwise_align(pairs, mode, cells=cells).collect()}
        assert len(found) == len(rows)
        for i, a, b in rows:
            a, b, r = a or "", b or "", found[i]
            assert r.score == naive_align(a, b, mode)
            assert r.aligned_a.replace("-", "") == a[r.a_start : r.a_end] and r.aligned_b.replace("-", "") == b[r.b_start : r.b_end]
            if mode == "global":
                assert (r.a_start, r.a_end, r.b_start, r.b_end) == (0, len(a), 0, len(b))
            assert len(r.aligned_a) == len(r.aligned_b) == r.columns and "--" not in {x + y for x, y in zip(r.aligned_a, r.aligned_b)}
            total, prior = 0, None
            for x, y in zip(r.aligned_a, r.aligned_b):
                kind = "a" if x == "-" else "b" if y == "-" else None
                total += (-2 if kind == prior else -5) if kind else 2 if x == y else -1
                prior = kind
            assert total == r.score
            assert r.matches == sum(x == y for x, y in zip(r.aligned_a, r.aligned_b))
            assert r.identity_pct is None if not min(len(a), len(b)) else r.identity_pct == 100 * r.matches / min(len(a), len(b))
    assert alignment.pairwise_align(pairs.limit(0), mode).count() == 0


def test_alignment_groups():
    """Pairs of every length run in few groups, hold the cell budget and leave few cells beyond the ends of texts."""
    rnd = random.Random(10)
    sizes = [(k, rnd.randint(0, 900), rnd.randint(0, 900)) for k in range(1000)]
    whole = {k: (n, m) for k, n, m in sizes}
    some = list(pairwise.groups(sizes, 1 << 24))
    assert sorted(k for g in some for k in g) == list(whole) and len(some) < 60
    cells = [sum(whole[k][0] + 1 for k in g) * (max(whole[k][1] for k in g) + 1) for g in some]
    assert max(cells) <= 1 << 24 and sum(cells) < 1.2 * sum((n + 1) * (m + 1) for n, m in whole.values())
    assert list(pairwise.groups([], 9)) == [] and list(pairwise.groups([(7, 50, 50)], 9)) == [[7]]


@pytest.mark.parametrize("local", [False, True])
@pytest.mark.parametrize("scores", [{}, {"match": 1.5, "mismatch": -0.75, "open_gap": -2.25, "extend_gap": -0.5}, {"match": 900, "mismatch": -700, "open_gap": -2000, "extend_gap": -40}, {"match": 1, "mismatch": 1, "open_gap": -1, "extend_gap": 0}])
def test_alignment_together(local, scores):
    """A pair has the same path alone as beside longer and shorter ones, and beside letters of many kinds."""
    rnd = random.Random(12)
    word = lambda letters, most: "".join(rnd.choices(letters, k=rnd.randint(0, most)))
    for letters in ("AC", "".join(map(chr, range(48, 300)))):
        aligner = pairwise.Aligner(pairwise.Scores(**scores), local)
        texts = [(word(letters, 60), word(letters, 80)) for _ in range(50)] + [("", ""), ("A", ""), ("", "AC")]
        xs, ys = ([aligner.s.codes(v) for v in side] for side in zip(*texts))
        for x, y, (*place, steps) in zip(xs, ys, aligner.batch(xs, ys)):
            (*alone, walked), = aligner.batch([x], [y])
            assert place == alone and steps.tolist() == walked.tolist()
            if len(steps):
                assert aligner._scored(x[place[1] : place[2]], y[place[3] : place[4]], place[1], place[3], steps)[0] == pytest.approx(place[0])


def test_alignment_whole_scores_are_small():
    """Whole scores run in the smallest integers that hold them, others as doubles."""
    kind = lambda n, **scores: pairwise.Aligner(pairwise.Scores(**scores), False)._numbers(n, n, -3.0, -3.0)[0]
    assert [kind(400), kind(4000), kind(400, match=1e9), kind(400, match=0.5)] == [np.int16, np.int32, np.float64, np.float64]


def test_alignment_matrix(spark):
    matrix = {("W", "W"): 11, ("A", "A"): 4, ("A", "W"): -3, ("A", "G"): 0, ("G", "G"): 6}
    pairs = spark.createDataFrame([(1, "AWGA", "AWA"), (2, "XA", "XA")], "pair_id int, a string, b string")
    found = {r["pair_id"]: r for r in alignment.pairwise_align(pairs, matrix=matrix, mismatch=-4, open_gap=-3, extend_gap=-1).collect()}
    assert (found[1].score, found[1].aligned_a, found[1].aligned_b) == (16, "AWGA", "AW-A")
    assert found[2].score == 0  # X is unknown to the matrix
    with pytest.raises(ValueError):
        alignment.pairwise_align(pairs, open_gap=-1, extend_gap=-2)


def test_alignment_columns(spark):
    msa = spark.createDataFrame([(1, 0, "ACGT-ACGTACGTAA"), (1, 1, "ACGT-ACGTACGTAC"), (1, 2, "ACCT-ACGTACGTAG")], "aln_id int, seq_id int, aligned string")
    assert alignment.msa_consensus(msa).first()["consensus"] == "ACGT-ACGTACGTAA"
    assert alignment.msa_conservation(msa).first()["conserved_pct"] == 80.0
    assert [(r["start"], r["end"]) for r in alignment.conserved_runs(msa, 3).collect()] == [(6, 14)]
    pairs = spark.createDataFrame([(0, "ATGA", "ATCAT")], "pair_id int, a string, b string")
    assert [(r["pos"], r["a"], r["b"]) for r in alignment.diff_positions(pairs).collect()] == [(3, "G", "C")]


def test_motif_scan_brute_force(spark):
    inst = spark.createDataFrame([("m", s) for s in ("TATAAGGCAT", "TATTAGGCAT", "TAAAAGGGAT", "TATATGGCTT")], "motif_id string, instance string")
    motif = alignment.motif_build(inst)
    assert alignment.motif_consensus(motif).first()["consensus"].startswith("TATAAGG")
    w = {(r["pos"], r["letter"]): r["weight"] for r in motif.collect()}
    rnd = random.Random(6)
    text = "".join(rnd.choice("ACGT") for _ in range(4000)) + "NTATAAGGCAT" + "".join(rnd.choice("ACGT") for _ in range(400))
    comp = str.maketrans("ACGT", "TGCA")
    want = set()
    for i in range(len(text) - 9):
        win = text[i : i + 10]
        if "N" in win:
            continue
        for strand, word in (("+", win), ("-", win.translate(comp)[::-1])):
            if sum(w[(p, c)] for p, c in enumerate(word)) >= 2.0:
                want.add((i, strand))
    got = {(r["pos"], r["strand"]) for r in alignment.motif_scan(spark.createDataFrame([(1, text)], "seq_id int, seq string"), motif, 2.0, True).collect()}
    assert got == want and got


def test_seed_candidates_are_whole(spark):
    rnd = random.Random(11)
    base = ["".join(rnd.choice("ACGT") for _ in range(60)) for _ in range(8)]
    rows = [(i, base[i % 8][: 40 + i % 20] + "".join(rnd.choice("ACGT") for _ in range(10))) for i in range(40)]
    df = spark.createDataFrame(rows, "seq_id int, seq string")
    words = {i: {s[k : k + 6] for k in range(len(s) - 5)} for i, s in rows}
    want = {(i, j) for i in words for j in words if len(words[i] & words[j]) >= math.ceil(len(words[i]) * 0.5)}
    got = {(r["query"], r["subject"]) for r in alignment.seed_candidates(df, df, 6, 0.5).collect()}
    assert got == want


def test_midpoint_leaves(spark):
    edges = spark.createDataFrame([("t", "a", "x", 1.0), ("t", "b", "x", 5.0), ("t", "x", "r", 1.0), ("t", "c", "r", 2.0)], "tree_id string, child string, parent string, blen double")
    row = phylogeny.midpoint_node(edges).first()
    assert {row["a"], row["b"]} == {"b", "c"} and row["half_distance"] == 4.0


def test_de_finds_changed_genes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(200):
        mean = rng.uniform(50, 300)
        for s in range(6):
            mu = mean * (4 if g < 10 and s >= 3 else 1)
            rows.append((g, s, int(rng.poisson(mu))))
    counts = spark.createDataFrame(rows, "gene int, sample int, n long")
    meta = spark.createDataFrame([(s, "trt" if s >= 3 else "ctrl") for s in range(6)], "sample int, condition string")
    res = {r["gene"]: r for r in expression.de_two_group(counts, meta, "trt", "ctrl").collect()}
    assert all(res[g]["padj"] < 0.01 and res[g]["log2FoldChange"] > 1 for g in range(10))
    assert sum(res[g]["padj"] < 0.05 for g in range(10, 200)) < 15
    with pytest.raises(ValueError):
        expression.align_samples(counts, meta.where("sample < 5"))


def test_tied_and_missing_values(spark):
    tied = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 1.0)] * 5, "g string, v double")
    r = hypothesis.mann_whitney(tied, "g", "v", "a", "b").first()
    assert (r["u"], r["z"], r["p"]) == (10.0, 0.0, 1.0)
    k = hypothesis.kruskal(tied, "g", "v").first()
    assert k["k"] == 2 and k["h"] is None and k["p"] is None
    some = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, "nan", 4)], "g string, v double")
    r = hypothesis.group_stats(some, "g", "v").first()
    assert (r["n"], r["mean"], r["median"]) == (4, 2.5, 2.5)


def test_concordance_of_real_times(spark):
    rows = spark.createDataFrame([(1.1, 1, 4.0), (1.2, 1, 3.0), (1.3, 0, 2.0), (1.4, 1, 1.0)], "time double, event int, risk double")
    r = survival.concordance_index(rows, "risk").first()
    assert (r["concordant"], r["comparable"], r["c_index"]) == (5, 5, 1.0)


def test_normality_without_order_uses_all_rows(spark):
    nd = statistics.NormalDist()
    rows = [(g, nd.inv_cdf((i - 0.375) / 6000.25)) for g in "xy" for i in range(1, 6001)] + [("z", v) for v in (1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in hypothesis.shapiro(df, "g", "v").collect()}
    assert got["x"]["n"] == 6000 and got["x"]["p"] > 0.5
    assert got["z"]["w"] == pytest.approx(1.0) and got["z"]["p"] == pytest.approx(1.0)
    assert hypothesis.stats_test(df.where("g <> 'z'"), "g", "v").first()["test"] == "Independent t-test"
    with pytest.raises(ValueError):
        hypothesis.shapiro(df, "g", "v", order="v")


def test_chi2_with_many_degrees_of_freedom(spark):
    from pyspark.sql import functions as F

    from strandframe.functions import distributions as D

    for k in (20_000, 200_000, 2_000_000):
        p = spark.range(1).select(D.chi2_upper(F.lit(float(k)), F.lit(float(k)))).first()[0]
        # median of chi-squared is about k - 2/3, density there 1 / sqrt(4 pi k)
        assert p == pytest.approx(0.5 - (2 / 3) / math.sqrt(4 * math.pi * k), abs=2e-6)

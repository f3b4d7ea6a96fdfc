"""Steps that run on whole rows as arrays, beside those for repeated ids and long texts, against plain loops."""

import collections

import pytest

from strandframe.operators import sequence
from strandframe.plans import letters

TEXTS = [(1, "ATGAAATAGCCATGCCCTGAATGTTT"), (2, "acgtacgtacgttéacgtéé𝄞ACG"), (3, ""), (4, "AC"), (5, None), (6, "ATGATGTAA" * 9 + "CATCATTTA"), (7, "GATTACA"), (7, "GATTAC"), (8, "TTTATTTCAT" * 4)]


@pytest.fixture(params=[1 << 20, 30])
def rows(spark, monkeypatch, request):
    # with 30 letters a text, the long ones go the other way
    monkeypatch.setattr(letters, "SLICE", request.param)
    return spark.createDataFrame(TEXTS, "seq_id long, seq string")


def whole():
    return [(i, t.upper()) for i, t in TEXTS if t is not None]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_kmers(rows, k):
    counts = collections.defaultdict(lambda: collections.defaultdict(list))
    for i, t in whole():
        for p in range(len(t) - k + 1):
            counts[i][t[p : p + k]].append(p)
    want = set()
    for i, seen in counts.items():
        best = sorted(seen, key=lambda w: (-len(seen[w]), min(seen[w])))[:3]
        want |= {(i, w, len(seen[w]), r + 1, sum(map(len, seen.values())), len(seen)) for r, w in enumerate(best)}
    got = [tuple(r) for r in sequence.kmer_count(rows, k, 3).collect()]
    # two first places are equal only in the repeated id
    assert {r for r in got if r[0] != 7} == {r for r in want if r[0] != 7} and len(got) == len(want)
    total = collections.Counter(w for seen in counts.values() for w, p in seen.items() for _ in p)
    n_seqs = collections.Counter(w for seen in counts.values() for w in seen)
    assert {tuple(r) for r in sequence.kmer_spectrum(rows, k).collect()} == {(w, total[w], n_seqs[w]) for w in total}


def test_long_windows_have_numbers():
    text = "ACGTTGCA" * 40 + "ACGTTGCC" * 3
    at, code = letters.windows(letters.Rows([text, "ACGTTGCA" * 12]), 60)
    joined = text + "ACGTTGCA" * 12
    named = {}
    for a, c in zip(at.tolist(), code.tolist(), strict=True):
        assert named.setdefault(c, joined[a : a + 60]) == joined[a : a + 60]
    assert len(set(named.values())) == len(named) and len(at) == len(text) - 59 + 96 - 59


def test_frames(rows):
    turn = str.maketrans("ACGT", "TGCA")
    closed, opened = set(), {}
    for i, t in whole():
        if i == 7:
            continue
        for strand, s in (("+", t), ("-", t.translate(turn)[::-1])):
            for f in range(3):
                start = None
                for p in range(f, len(s) - 2, 3):
                    if s[p : p + 3] == "ATG" and start is None:
                        start = p
                    elif s[p : p + 3] in sequence.STOPS:
                        if start is not None and p + 3 - start >= 9:
                            closed.add((i, strand, f + 1, start, p + 3, p + 3 - start))
                        start = None
                if start is not None:
                    opened[i, strand, f + 1] = start
    assert {tuple(r) for r in sequence.all_orfs(rows, 9).collect()} == closed and closed
    assert {tuple(r[:3]): r[3] for r in sequence.truncated_orfs(rows).collect()} == opened and opened


def test_pieces_and_skew(rows):
    from strandframe.operators import restriction

    sites = {"One": ("GAT", 1), "Far": ("ATGR", 6), "Odd": ("TTT", 0)}
    turned = [("GAT", 1), ("ATC", 1), ("ATGR", 6), ("YCAT", 6), ("TTT", 0), ("AAA", 0)]
    bases = {"R": "AG", "Y": "CT"}
    pieces, skews = set(), {}
    for i, t in whole():
        if i == 7:
            continue
        cuts = {p + off for s, off in turned for p in range(len(t) - len(s) + 1) if all(c in bases.get(x, x) for x, c in zip(s, t[p:]))}
        edges = [0, *sorted(c for c in cuts if 0 < c < len(t)), len(t)]
        pieces |= {(i, a + 1, b, b - a) for a, b in zip(edges, edges[1:]) if t}
        total = 0.0
        for chunk, p in enumerate(range(0, len(t), 4)):
            g, c = t[p : p + 4].count("G"), t[p : p + 4].count("C")
            skew = (g - c) / (g + c) if g + c else 0.0
            total += round(skew, 4)
            skews[i, chunk] = (pytest.approx(skew, abs=6e-5), pytest.approx(total, abs=1e-9))
    got = {tuple(r) for r in restriction.digest_fragments(rows, list(sites), enzymes=sites).collect()}
    assert {r for r in got if r[0] != 7} == pieces
    assert {(r["seq_id"], r["chunk"]): (r["skew"], r["cumulative"]) for r in sequence.gc_skew(rows, 4).where("seq_id <> 7").collect()} == skews


def test_counts_and_codes(spark):
    from pyspark.sql import functions as F

    from strandframe.functions import dna

    df = spark.createDataFrame([("ARNé*?",), ("",), (None,), ("WW",)], "seq string")
    r = df.select(dna.letter_counts("seq"), dna.to_three_letter("seq"), dna.to_one_letter(F.lit("alaARGxyzTe")), dna.pair_sums("seq")).collect()
    assert sum(r[0][0]) == 3 and r[0][0][0] == 1 and r[3][0][22] == 2 and sum(r[1][0]) == 0 and r[2][0] is None
    assert [x[1] for x in r] == ["AlaArgAsnXaaTerXaa", "", None, "TrpTrp"] and r[0][2] == "ARX" and r[0][3]["dh"] == 0
    got = spark.createDataFrame([("ACGTNA",)], "s string").select(dna.pair_sums("s").alias("p"), dna.frame_proteins("s").alias("f")).first()
    assert (got["p"]["dh"], got["p"]["ds"]) == (-8.4 - 10.6 - 8.4, -22.4 - 27.2 - 22.4) and got["f"] == ["TX", "R", "V"]


def test_motif_windows_end_with_their_row(spark):
    from strandframe.operators import alignment as A

    weights = [("m", p, x, 1.0 if x == "ACG"[p] else -1.0) for p in range(3) for x in "ACGT"]
    motif = spark.createDataFrame(weights, "motif_id string, pos int, letter string, weight double")
    df = spark.createDataFrame([(1, "TTAC"), (2, "GACG"), (3, ""), (4, "acgNCGT"), (5, "AC")], "seq_id long, seq string").coalesce(1)
    got = {tuple(r) for r in A.motif_scan(df, motif, 3.0, both_strands=True).select("seq_id", "pos", "strand").collect()}
    assert got == {(2, 1, "+"), (4, 0, "+"), (4, 4, "-")}

"""Primer pairs against a plain loop over all candidates."""

import math

import pytest

from strandframe.functions import tables as T
from strandframe.operators import design

TURN = str.maketrans("ACGT", "TGCA")


def measured(p):
    heat, order = (sum(T.NEIGHBOUR_ENERGY.get(p[i : i + 2], (0.0, 0.0))[w] for i in range(len(p) - 1)) for w in (0, 1))
    for end in (p[0], p[-1]):
        both = T.END_ENERGY_AT if end in "AT" else T.END_ENERGY_GC if end in "GC" else (0.0, 0.0)
        heat, order = heat + both[0], order + both[1]
    order += 0.368 * (len(p) - 1) * math.log(0.05) + 1.987 * math.log(12.5e-9)
    known = sum(c in "ACGT" for c in p)
    return 1000 * heat / order - 273.15, 100 * sum(c in "GC" for c in p) / known if known else 0.0


def plain(s, product):
    found = []
    for start in range(min(50, len(s) - 25)):
        for length in range(18, 26):
            back = min(start + product, len(s)) - length
            if back < start + length:
                continue
            f, r = s[start : start + length], s[back : back + length].translate(TURN)[::-1]
            (t1, g1), (t2, g2) = measured(f), measured(r)
            if abs(t1 - t2) < 5 and abs(g1 - g2) < 10:
                score = sum(max(0, 10 - d) for d in (abs(t1 - t2), abs(g1 - g2), abs(length - 20)))
                found.append((-round(score, 2), start, length, f, r, back))
    return sorted(found)


def test_primers_equal_plain_loop(spark):
    # neighbours of N have no energy; they took that of another pair before
    texts = {1: "ACGTTGCANCCATNGGATCCTANACGTCNAGGT" * 4, 2: "ATTGCCGATACCGGTTAACG" * 40, 3: "ACGTAGCTAGGCTTAACCGGATCTAG", 4: "ACGT", 5: "ACGU" * 30, 6: None}
    df = spark.createDataFrame(list(texts.items()), "seq_id long, seq string")
    got = {}
    for r in design.primer_pairs(df, product_size=100).orderBy("seq_id", "rank").collect():
        got.setdefault(r["seq_id"], []).append(r)
    for k in (1, 2, 3):
        want = plain(texts[k], 100)
        assert len(got.get(k, [])) == min(5, len(want))
        for r, (neg, start, length, f, back, at) in zip(got.get(k, []), want):
            assert (r["fwd_position"], r["length"], r["forward"], r["reverse"], r["rev_position"], r["n_candidates"]) == (start, length, f, back, at, len(want))
            assert r["score"] == pytest.approx(-neg, abs=0.011)
    assert set(got) <= {1, 2, 3} and {1, 2} <= set(got)

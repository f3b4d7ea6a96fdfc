"""Enzymes that cut beside their site, on linear and circular sequences."""

import pytest

from strandframe.operators import restriction

ENZYMES = {"BsaI": ("GGTCTC", 7, 11), "BsmBI": ("CGTCTC", 7, 11), "EcoRI": ("GAATTC", 1)}


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def naive(seq, linear):
    n, out = len(seq), set()
    text = seq if linear else seq * 2
    for name, (site, top, *bottom) in ENZYMES.items():
        below = bottom[0] if bottom else len(site) - top
        for word, offset in ((site, top), (turned(site), len(site) - below)):
            for i in range(n):
                if text[i : i + len(site)] == word:
                    cut = i + offset + 1
                    if not linear:
                        out.add((name, (cut - 1) % n + 1))
                    elif 1 < cut <= n:
                        out.add((name, cut))
    return out


@pytest.mark.parametrize("linear", [True, False])
def test_cuts_beside_the_site(spark, linear):
    texts = ["AAAAGGTCTCAAAAAAAAAAAA", "GGTCTCAAAA", "AAGAGACCTTTTTTTTTTTTT", "GAGACCAAAAAAGAATTCAA", "TTTTTTTTTTTTGGTCTC", "TCAAAAAAAAAAAAAAAAGGTC", "CGTCTCACGTCTCAAAAAAAAAAAAAAGAGACG", "ACGT"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id int, seq string")
    got = {(r.seq_id, r.enzyme, r.cut) for r in restriction.cut_rows(df, linear=linear, enzymes=ENZYMES).collect()}
    want = {(i, *hit) for i, t in enumerate(texts) for hit in naive(t, linear)}
    assert got == want and got

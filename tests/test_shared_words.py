"""Shared k-mers from an index of a block: the same as all pairs, without a row for each k-mer."""

import math
import random

import pyarrow as pa
import pytest

from strandframe.operators import alignment
from strandframe.plans import blocks, shared_words, tiles


def brute(queries, subjects, k, share):
    words = lambda t: {t[i : i + k] for i in range(len(t or "") - k + 1)}
    q, s = [words(t) for t in queries], [words(t) for t in subjects]
    return {(i, j, len(x & y), len(x)) for i, x in enumerate(q) for j, y in enumerate(s) if x & y and len(x & y) >= math.ceil(len(x) * share)}


@pytest.mark.parametrize("width", [1 << 20, 100])
@pytest.mark.parametrize(("letters", "k"), [("ACGT", 4), ("ACGTé😀", 4), ("ACGT", 40), ("abcdefghijklmnopqrstuvwxyz", 6), ("A", 3)])
def test_index(monkeypatch, letters, k, width):
    monkeypatch.setattr(shared_words, "SLICE", width)
    rng = random.Random(5)
    base = ["".join(rng.choices(letters, k=60)) for _ in range(4)]
    held = [b[rng.randrange(15) :] + "".join(rng.choices(letters[:3], k=rng.randrange(30))) for b in base * 6] + ["", letters[0] * 50]
    asked = [b[rng.randrange(15) :] + "".join(rng.choices(letters + "xé", k=rng.randrange(30))) for b in base * 6] + ["", "AC", letters[0] * 50, "zz" * 30]
    index = shared_words.Index(pa.array(held), k)
    for share in (0.1, 0.5, 1.0):
        got = [(at + a, *rest) for at, part in shared_words.slices(pa.array(asked), 200) for a, *rest in zip(*(x.tolist() for x in index.shared(part, share)))]
        want = brute(asked, held, k, share)
        assert len(got) == len(want) and set(got) == want


def test_no_rows_of_kmers_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "JOINED", 0)
    monkeypatch.setattr(tiles, "kmer_rows", lambda *_: pytest.fail("a row for every k-mer"))
    rng = random.Random(6)
    texts = ["".join(rng.choices(["the", "ing", "and", "of"], k=20)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "seq_id int, seq string")
    got = {tuple(r) for r in alignment.seed_candidates(df, df, 8).collect()}
    assert got == brute(texts * 2, texts * 2, 8, 0.5) and len(got) > 2 * len(texts)


def test_few_meetings_of_many_pairs(spark):
    # every two texts have one stretch in common, which no other text holds
    rng = random.Random(7)
    own = [[] for _ in range(40)]
    for i in range(40):
        for j in range(i):
            stretch = "".join(rng.choices("ACGTKMRSWY", k=16))
            own[i].append(stretch)
            own[j].append(stretch)
    texts = ["".join(rng.sample(x, len(x))) for x in own] + [own[0][0] * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id int, seq string")
    out = alignment.seed_candidates(df, df, 8, 0.5)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.collect()} == brute(texts, texts, 8, 0.5)

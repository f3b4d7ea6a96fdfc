"""Repeated windows by stretches of one anchor: against brute force, and by what is stored on the way."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strandframe.llm import repeats

DOC = "doc_id long, text string"


def removed(texts, window):
    split = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    for w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield len(w), gone.sum(), hashlib.sha256(left.encode()).hexdigest()


def agree(spark, texts, window):
    got = {r.doc_id: r for r in repeats.repeated_words(spark.createDataFrame(list(enumerate(texts)), DOC).repartition(3), window).collect()}
    for doc, row in enumerate(removed(texts, window)):
        assert (got[doc].n_words, got[doc].n_removed, got[doc].kept_sha256) == row


def test_windows_of_equal_stretches_are_not_stored(spark, monkeypatch):
    rng = random.Random(3)
    line = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base, passage = line(600), line(35)
    near = [*base[:300], "changed", *base[301:]]
    texts = [" ".join(w) for w in (base, near, line(40) + passage + line(40), line(30) + passage + line(9), line(500), line(20))]
    kept = Counter()
    plain = repeats.stored

    def counted(df, stem="step"):
        found = plain(df, stem)
        kept[stem] += found.count()
        return found

    monkeypatch.setattr(repeats, "stored", counted)
    agree(spark, texts, 35)
    # 1,146 windows hold a repeated anchor
    assert kept["windows"] < 250
    assert kept["windows"] + kept["stretches"] < 500


@pytest.mark.parametrize("window", [1, 2, 7])
def test_few_words(spark, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choices("abcde", k=rng.randint(0, 25))) for _ in range(25)] + [None, "", "x y z", "x y z", "a " * 30]
    agree(spark, texts, window)


@pytest.mark.parametrize("window", [2, 7, 35])
def test_stretches_cover_all_windows(window):
    h = np.random.default_rng(window).integers(0, 6, 900).astype(np.uint64)
    for n in (0, window - 1, window, window + 1, 900):
        keys, sizes = repeats.anchors_of(h[:n], window, max(1, window // 2))
        assert len(keys) == len(sizes) and sizes.sum() == max(0, n - window + 1) and (sizes > 0).all()

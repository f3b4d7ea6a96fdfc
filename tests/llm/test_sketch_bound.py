"""The sketch bound of near duplicates never loses a link."""

import numpy as np

from strandframe.llm import near_dedup
from strandframe.llm.words import scramble


def test_bound_holds_and_prunes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        n = int(rng.integers(1, 400))
        base = scramble(rng.integers(0, 1 << 62, n).astype(np.uint64))
        keep = rng.random(n) < rng.uniform(0.6, 1)
        other = np.concatenate([base[keep], scramble(rng.integers(0, 1 << 62, int(rng.integers(0, 60))).astype(np.uint64))])
        a, b = np.unique(base), np.unique(other if len(other) else base[:1])
        common = len(np.intersect1d(a, b))
        rows.append((k, near_dedup.sketch(a).tolist(), near_dedup.sketch(b).tolist(), len(a), len(b), 100 * common >= 85 * (len(a) + len(b) - common)))
    table = spark.createDataFrame(rows, "k int, a array<long>, b array<long>, n long, m long, linked boolean")
    got = table.select("linked", near_dedup.may_link("a", "b", "n", "m", 85).alias("open")).collect()
    assert all(r.open for r in got if r.linked) and sum(r.linked for r in got) > 30
    assert sum(r.open and not r.linked for r in got) < 60

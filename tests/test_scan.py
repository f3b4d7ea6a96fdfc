"""Running scans against plain loops, over several spans of blocks and both directions."""

import random

import pytest

from strandframe.operators import intervals, verbs
from strandframe.plans import scan


@pytest.mark.parametrize("span", [2, 1024])
def test_running_sides(spark, monkeypatch, span):
    monkeypatch.setattr(scan, "SPAN", span)
    rng = random.Random(3)
    rows = [(k, p, rng.randint(-9, 9)) for k in "ab" for p in sorted(rng.sample(range(-400, 900), 60))]
    df = spark.createDataFrame(rows, "k string, p long, v long").withColumn("_block", scan.width_block("p", 16))
    sides = {"before": lambda i, n: range(i), "upto": lambda i, n: range(i + 1), "after": lambda i, n: range(i + 1, n), "onward": lambda i, n: range(i, n)}
    specs = [(f"{fn}_{side}", "v", fn, side) for fn in ("sum", "min", "max") for side in sides]
    out = scan.running(df, ["k"], ["p"], "_block", specs)
    # a frame that runs to the end is summed anew for every row
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {(r.k, r.p): r for r in out.collect()}
    for k in "ab":
        own = [(p, v) for key, p, v in rows if key == k]
        for i, (p, _) in enumerate(own):
            for fn, f in (("sum", sum), ("min", min), ("max", max)):
                for side, places in sides.items():
                    part = [own[j][1] for j in places(i, len(own))]
                    assert got[k, p][f"{fn}_{side}"] == (f(part) if part else (0 if fn == "sum" else None))


def test_repeated_intervals_merge_once(spark):
    rng = random.Random(4)
    rows = [("c", s, s + rng.randint(1, 40)) for s in rng.sample(range(5000), 150)] * 4
    df = spark.createDataFrame(rows, "chrom string, start0 long, end0 long")
    want = []
    for _, s, e in sorted(rows):
        if want and s <= want[-1][1]:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    assert sorted([r.start0, r.end0] for r in intervals.merge_intervals(df).collect()) == want
    starts = sorted({s for _, s, _ in rows})
    gaps = {r.start0: r.gap for r in verbs.consecutive_gap(df, "chrom", "start0").collect()}
    assert gaps == dict(zip(starts, [t - s for s, t in zip(starts, starts[1:])] + [None], strict=True))

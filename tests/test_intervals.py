"""Interval operators against brute force, with blocks and salts forced small."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import coordinates as C
from strandframe.operators import intervals, variants


def ivals(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} int, chrom string, start0 long, end0 long, strand string")


def make(seed, n, span=3000, longest=400):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = rnd.randrange(span)
        size = rnd.choice([1, 3, 10, 40, longest if i % 17 == 0 else 5])
        # one chromosome holds most rows
        out.append((i, "a" if rnd.random() < 0.7 else "b", s, s + size, rnd.choice("+-")))
    return out


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(intervals, "_SPAN", 128)


def test_overlap_join_with_salts(spark):
    a, b = make(1, 250), make(2, 120, longest=1500)
    want = {(x[0], y[0]): min(x[3], y[3]) - max(x[2], y[2]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]}
    got = intervals.find_overlaps(ivals(spark, a, "i"), ivals(spark, b, "j"), "i", "j", hot_rows=20).collect()
    assert len(got) == len(want) and {(r["i"], r["j"]): r["overlap"] for r in got} == want


def test_count_overlaps(spark):
    a, b = make(3, 200), make(4, 150)
    want = {x[0]: sum(x[1] == y[1] and x[2] < y[3] and y[2] < x[3] for y in b) for x in a}
    got = {r["i"]: r["n_overlaps"] for r in intervals.count_overlaps(ivals(spark, a, "i"), ivals(spark, b, "j"), "i").collect()}
    assert got == want


def merged(rows):
    """Runs of covered bases of half-open intervals."""
    covered = {base for start, end in rows for base in range(start, end)}
    return list(zip(sorted(b for b in covered if b - 1 not in covered), sorted(b + 1 for b in covered if b + 1 not in covered)))


def test_merge_and_complement(spark):
    rows = make(5, 60, span=20000)
    want = {(c, s, e) for c in "ab" for s, e in merged([(r[2], r[3]) for r in rows if r[1] == c])}
    df = ivals(spark, rows)
    got = {(r["chrom"], r["start0"], r["end0"]) for r in intervals.merge_intervals(df).collect()}
    assert got == want
    sizes = spark.createDataFrame([("a", 25000), ("b", 25000), ("c", 10)], "chrom string, size long")
    gaps = intervals.complement_intervals(df, sizes)
    covered = sum(e - s for _, s, e in want)
    assert gaps.agg(F.sum(F.col("end0") - F.col("start0"))).first()[0] == 50010 - covered
    small = ivals(spark, [(0, "a", 0, 5, "+"), (1, "a", 5, 7, "+"), (2, "a", 10, 12, "+"), (3, "a", 11, 20, "+")])
    assert sorted((r["start0"], r["end0"]) for r in intervals.merge_intervals(small).collect()) == [(0, 7), (10, 20)]


def test_coverage_sums_to_length(spark):
    rows = make(6, 300)
    cov = intervals.coverage(ivals(spark, rows))
    assert cov.agg(F.sum((F.col("end0") - F.col("start0")) * F.col("depth"))).first()[0] == sum(r[3] - r[2] for r in rows)
    depth = {}
    for _, c, s, e, _ in rows:
        for p in range(s, e):
            depth[(c, p)] = depth.get((c, p), 0) + 1
    for r in cov.collect():
        assert {depth.get((r["chrom"], p)) for p in range(r["start0"], r["end0"])} == {r["depth"]}


def test_coordinates(spark):
    row = spark.range(1).select(C.to_zero_start(F.lit(100), "gff"), C.to_zero_start(F.lit(99), "bed"), C.plain_chromosome(F.lit("MT")), C.plain_chromosome(F.lit("chr7"), prefix=False)).first()
    assert tuple(row) == (99, 99, "chrM", "7")


def test_resize_and_bounds(spark):
    df = ivals(spark, [(0, "a", 10, 20, "+"), (1, "a", 10, 20, "-"), (2, "z", 0, 1, "+"), (3, "a", 95, 120, "+")])
    r = {x["id"]: (x["start0"], x["end0"]) for x in intervals.resize(df, 4, "start").collect()}
    assert r[0] == (10, 14) and r[1] == (16, 20)
    sizes = spark.createDataFrame([("a", 100)], "chrom string, size long")
    s = {x["id"]: x["status"] for x in intervals.bounds_check(df, sizes).collect()}
    assert s == {0: "ok", 1: "ok", 2: "unknown chromosome", 3: "end beyond chromosome"}


def test_trim_alleles(spark):
    def naive(pos, ref, alt):
        """Cut the longest common end, then the longest common start, and leave a letter to both."""
        common = lambda a, b, most: next((k for k in range(most, 0, -1) if a[:k] == b[:k]), 0)
        most = min(len(ref), len(alt)) - 1
        tail = common(ref[::-1], alt[::-1], most)
        head = common(ref, alt, most - tail)
        return pos + head, ref[head : len(ref) - tail], alt[head : len(alt) - tail]

    rnd = random.Random(9)
    rows = [(i, i, "".join(rnd.choice("AC") for _ in range(rnd.randint(1, 6))), "".join(rnd.choice("AC") for _ in range(rnd.randint(1, 6)))) for i in range(200)]
    df = spark.createDataFrame(rows, "var_id int, pos int, ref string, alt string")
    for r in variants.trim_alleles(df).collect():
        _, p, ref, alt = rows[r["var_id"]]
        assert (r["pos"], r["ref"], r["alt"]) == naive(p, ref, alt)

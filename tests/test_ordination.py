"""Principal coordinates and the concordance index against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import microbiome as M
from strandframe.operators import survival as S


def pairs_of(spark, d, names):
    rows = [(names[i], names[j], float(d[i, j])) for i in range(len(d)) for j in range(i + 1, len(d))]
    return spark.createDataFrame(rows, "a string, b string, distance double")


def centred(d):
    j = np.eye(len(d)) - 1 / len(d)
    return -0.5 * j @ (d**2) @ j


def test_star_has_no_false_axis(spark):
    """Three points at mutual distance 2 and one at distance 1 from all: no flat space holds them."""
    d = np.array([[0, 2, 2, 1], [2, 0, 2, 1], [2, 2, 0, 1], [1, 1, 1, 0]], float)
    found = M.pcoa(pairs_of(spark, d, "wxyz"), k=3).collect()
    want = np.linalg.eigvalsh(centred(d))
    assert (want < -1e-9).sum() == 1 and {r.axis for r in found} == {1, 2}
    assert sum({r.axis: r.explained for r in found}.values()) == pytest.approx(1)
    assert sorted({round(r.eigenvalue, 9) for r in found}) == sorted({round(v, 9) for v in want if v > 1e-9})


@pytest.mark.parametrize("extra", [4, 30])
def test_coordinates(spark, extra, monkeypatch):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(45, 4)) * [9, 5, 2, 1]
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    names = [f"s{i:02d}" for i in range(45)]
    if extra == 4:
        plain = M.leading_pairs
        monkeypatch.setattr(M, "leading_pairs", lambda m, k, n: plain(m, k, n, extra=2))
    found = M.pcoa(pairs_of(spark, d, names), k=3).collect()
    b = centred(d)
    values, vectors = np.linalg.eigh(b)
    for axis in (1, 2, 3):
        rows = sorted((r.sample, r.coordinate, r.eigenvalue, r.explained) for r in found if r.axis == axis)
        got = np.array([r[1] for r in rows])
        assert np.allclose(b @ got, values[-axis] * got, atol=1e-4) and rows[0][2] == pytest.approx(values[-axis], rel=1e-7)
        assert abs(vectors[:, -axis] @ got) == pytest.approx(np.sqrt(values[-axis]), rel=1e-6) and got[np.abs(got).argmax()] > 0
        assert rows[0][3] == pytest.approx(values[-axis] / values[values > 0].sum(), rel=1e-6)


def test_few_axes_and_no_pairs(spark):
    two = M.pcoa(spark.createDataFrame([("a", "b", 4.0)], "a string, b string, distance double"), k=2).collect()
    assert sorted((r.sample, r.axis, round(r.coordinate, 9)) for r in two) == [("a", 1, 2.0), ("b", 1, -2.0)]
    none = spark.createDataFrame([], "a string, b string, distance double")
    assert M.pcoa(none).count() == 0
    same = spark.createDataFrame([("a", "b", 0.0)], "a string, b string, distance double")
    assert M.pcoa(same).count() == 0


def naive_concordance(rows):
    c = t = n = 0
    for t1, e1, r1 in rows:
        for t2, e2, r2 in rows:
            if e1 == 1 and (t2 > t1 or (t2 == t1 and e2 == 0)):
                n += 1
                c += r2 < r1
                t += r2 == r1
    return c, t, n


@pytest.mark.parametrize("width", [4, 30, 1 << 16])
@pytest.mark.parametrize("kind", ["int", "double"])
def test_concordance_by_blocks(spark, width, kind, monkeypatch):
    monkeypatch.setattr(S, "_BLOCK_ROWS", width)
    rng = random.Random(width)
    rows = [(rng.choice([5, 5, 5, rng.randint(1, 60)]), rng.randint(0, 1), rng.choice([0.5, rng.randint(0, 40) / 4, rng.random()])) for _ in range(260)]
    if kind == "double":
        rows = [(t + 0.25, e, r) for t, e, r in rows]
    df = spark.createDataFrame([(t, e, r) for t, e, r in rows] + [(3 if kind == "int" else 3.0, 1, None)], f"time {kind}, event int, risk double").repartition(5)
    got = S.concordance_index(df, "risk").first()
    assert (got.concordant, got.tied, got.comparable) == naive_concordance(rows)
    assert got.c_index == pytest.approx((got.concordant + got.tied / 2) / got.comparable)


def test_concordance_without_pairs(spark):
    none = spark.createDataFrame([], "time int, event int, risk double")
    assert tuple(S.concordance_index(none, "risk").first()) == (0, 0, 0, None)
    one = spark.createDataFrame([(3, 1, 0.5)], "time int, event int, risk double")
    assert tuple(S.concordance_index(one, "risk").first()) == (0, 0, 0, None)


def test_later_and_smaller():
    rng = np.random.default_rng(0)
    for n in (1, 7, 300, 900):
        t, r, c, d = rng.integers(0, 40, n), rng.integers(0, 50, n), rng.integers(0, 4, n), rng.integers(0, 3, n)
        after = t[None] > t[:, None]
        weight = d[:, None] * c[None]
        assert S.later_and_smaller(t, r, c, d) == (int((weight * (after & (r[None] < r[:, None]))).sum()), int((weight * (after & (r[None] == r[:, None]))).sum()))

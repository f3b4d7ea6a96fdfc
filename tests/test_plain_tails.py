"""Normal tails and the smaller binomial tail against exact sums; these run without steps per term."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import distributions as D
from strandframe.functions.discrete import binomial_two_sided


def test_normal_tails(spark):
    zs = [0.0, 1e-9, 0.3, -0.5, 0.6629, 1.0, -1.96, 5.6, -5.7, 8.0, 20.0, 37.0, 50.0, -50.0, float("inf"), float("-inf")]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", D.normal_upper(F.col("z")), D.normal_two_sided(F.col("z"))).collect()
    for z, up, both in rows:
        assert up == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-12, abs=1e-300)
        assert both == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-12, abs=1e-300)
    # the series of 80 steps was used before
    assert "aggregate" not in str(D.normal_upper(F.col("z")))


@pytest.mark.parametrize("p", [0.3, 0.5, 0.9])
def test_binomial(p):
    n = 60
    point = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    want = [min(1.0, 2 * min(sum(point[x:]), sum(point[: x + 1]))) for x in range(n + 1)]
    assert binomial_two_sided(np.arange(n + 1), np.full(n + 1, n), np.full(n + 1, p)) == pytest.approx(want, rel=1e-9)

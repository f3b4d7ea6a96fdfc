"""Tails of discrete distributions in Arrow batches: terms follow from their ratio, none is stored.

The probability of one count is taken in Loader's deviance form, which loses no
digits for large counts; a tail is then summed from that count outward, away from
the mode, until the rest cannot matter.  Work grows with the square root of the
counts, memory not at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 512


def log_side(
    x: np.ndarray, low: np.ndarray, high: np.ndarray, log_ratio: Callable[[np.ndarray, np.ndarray], np.ndarray], up: bool, falling: np.ndarray
) -> np.ndarray:
    """ln of the sum of p(k) / p(x) over k >= x (``up``) or k <= x within [low, high].

    ``log_ratio(rows, k)`` is ln p(k + 1) - ln p(k).  Where ratios fall along k
    (``falling``) a row ends once the rest, bounded by a geometric row, cannot
    count; otherwise all its terms are added.
    """
    out, last = np.zeros(len(x)), np.zeros(len(x))
    at, live = x.astype(float), np.flatnonzero(x < high if up else x > low)
    hop = np.arange(STEP)
    while len(live):
        k = at[live, None] + hop if up else at[live, None] - 1 - hop
        inside = k < high[live, None] if up else k >= low[live, None]
        k = np.clip(k, low[live, None], np.maximum(high[live, None] - 1, low[live, None]))
        ratio = log_ratio(live, k) if up else -log_ratio(live, k)
        terms = np.where(inside, last[live, None] + np.cumsum(np.where(inside, ratio, 0.0), axis=1), -np.inf)
        top = np.maximum(terms.max(axis=1), out[live])
        out[live] = top + np.log(np.exp(out[live] - top) + np.exp(terms - top[:, None]).sum(axis=1))
        at[live] += STEP if up else -STEP
        last[live] = terms[:, -1]
        # rest <= term * r / (1 - r)
        edge = ratio[:, -1]
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            small = (edge < 0) & (terms[:, -1] + edge - np.log(-np.expm1(edge)) < out[live] - 40)
        live = live[inside[:, -1] & ~(small & falling[live])]
    return out


_SMALL = np.array([0.0] + [math.lgamma(n + 1) - (0.5 * math.log(2 * math.pi * n) + n * math.log(n) - n) for n in range(1, 16)])


def stirling_error(n: np.ndarray) -> np.ndarray:
    """ln n! minus Stirling's formula (for whole n >= 0; 0 at 0)."""
    large = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / large**2) / large**2) / large**2) / large
    return np.where(n < 16, _SMALL[np.minimum(n, 15).astype(int)], series)


def deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x ln(x / m) + m - x, by its series where x is near m."""
    x, m = np.broadcast_arrays(np.asarray(x, float), np.asarray(m, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0) / m), 0.0) + m - x
        v = np.where(x + m > 0, (x - m) / (x + m), 0.0)
    series, power = (x - m) * v, 2 * x * v
    for j in range(1, 20):
        power = power * v * v
        series = series + power / (2 * j + 1)
    return np.where(np.abs(v) < 0.1, series, plain)


def log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln of the binomial probability of ``x`` in ``n`` for 0 < p < 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = (
            stirling_error(n) - stirling_error(x) - stirling_error(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p))
            + 0.5 * np.log(n / (2 * np.pi * np.maximum(x, 1) * np.maximum(n - x, 1)))
        )
        return np.where(x == 0, n * np.log1p(-p), np.where(x == n, n * np.log(p), middle))


class Drawn:
    """Marked items among ``drawn`` of ``whole`` items of which ``marked`` are marked (hypergeometric)."""

    def __init__(self, drawn: np.ndarray, marked: np.ndarray, whole: np.ndarray):
        self.n, self.k, self.all = (np.asarray(v, float) for v in (drawn, marked, whole))
        self.low, self.high = np.maximum(0.0, self.n + self.k - self.all), np.minimum(self.n, self.k)
        self.falling = np.ones(len(self.n), bool)
        self.mode = np.clip(np.floor((self.n + 1) * (self.k + 1) / (self.all + 2)), self.low, self.high)

    def _ratio(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        n, k, whole = (v[rows, None] for v in (self.n, self.k, self.all))
        return np.log((k - at) * (n - at)) - np.log((at + 1) * (whole - k - n + at + 1))

    def log_p(self, x: np.ndarray) -> np.ndarray:
        share = self.n / self.all
        inner = log_binomial(x, self.k, share) + log_binomial(self.n - x, self.all - self.k, share) - log_binomial(self.n, self.all, share)
        return np.where(self.low == self.high, 0.0, inner)

    def _tail(self, x: np.ndarray, up: bool) -> np.ndarray:
        """P(X >= x) or P(X <= x) for x within the support, on the mode's own side."""
        return np.exp(self.log_p(x) + log_side(x, self.low, self.high, self._ratio, up, self.falling))

    def upper(self, x: np.ndarray) -> np.ndarray:
        """P(X >= x)."""
        x = np.asarray(x, float)
        above = x > self.mode
        inside = np.clip(np.where(above, x, x - 1), self.low, self.high)
        p = np.where(above, 0.0, 1.0)
        for rows, up in ((np.flatnonzero(above), True), (np.flatnonzero(~above), False)):
            part = Drawn(self.n[rows], self.k[rows], self.all[rows])._tail(inside[rows], up)
            p[rows] = part if up else 1 - part
        return np.where(x <= self.low, 1.0, np.where(x > self.high, 0.0, np.clip(p, 0.0, 1.0)))

    def two_sided(self, x: np.ndarray, slack: float = 1e-7) -> np.ndarray:
        """Sum of all probabilities not above that of ``x`` (up to ``slack``)."""
        x = np.asarray(x, float)
        limit = self.log_p(x) + slack
        above = x > self.mode
        # the first count beyond the mode on the other side that is as rare, by bisection
        near, far = self.mode.copy(), np.where(above, self.low - 1, self.high + 1)
        while (np.abs(far - near) > 1).any():
            mid = np.where(np.abs(far - near) > 1, np.floor((near + far) / 2), near)
            rare = self.log_p(np.clip(mid, self.low, self.high)) <= limit
            far = np.where(rare & (mid != near), mid, far)
            near = np.where(rare, near, mid)
        out = np.zeros(len(x))
        for up in (True, False):
            start = np.where(above == up, x, far)
            rows = np.flatnonzero((start <= self.high) & (start >= self.low))
            out[rows] += Drawn(self.n[rows], self.k[rows], self.all[rows])._tail(start[rows], up)
        return np.where(self.log_p(self.mode) <= limit, 1.0, np.minimum(1.0, out))


def binomial_two_sided(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Twice the smaller of P(X >= x) and P(X <= x), at most 1, for whole 0 <= x <= n and 0 < p < 1.

    The tail away from the mode is summed; it is the smaller one or the other is above one half.
    """
    x, n, p = (np.asarray(v, float) for v in (x, n, p))
    up = x > n * p
    log_odds = np.log(p) - np.log1p(-p)
    out = np.zeros(len(x))
    for side in (True, False):
        rows = np.flatnonzero(up == side)
        m, odds = n[rows], log_odds[rows]
        ratio = lambda live, k, m=m, odds=odds: np.log(m[live, None] - k) - np.log(k + 1) + odds[live, None]
        some = log_side(x[rows], np.zeros(len(rows)), m, ratio, side, np.ones(len(rows), bool))
        own = log_binomial(x[rows], m, p[rows])
        near, point = np.exp(own + some), np.exp(own)
        # the other side holds the rest and this count
        out[rows] = np.minimum(1.0, 2 * np.minimum(near, 1 - near + point))
    return out


def _on_rows(test: Callable[..., np.ndarray], *columns: pd.Series) -> pd.Series:
    given = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns])
    out = np.full(given.shape[1], np.nan)
    rows = np.flatnonzero(~np.isnan(given).any(axis=0))
    for at in range(0, len(rows), 2048):
        some = rows[at : at + 2048]
        out[some] = test(*given[:, some])
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def _column(test: Callable[..., np.ndarray], *given: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return _on_rows(test, a, b, c, d)

    return run(*[c.cast("double") for c in given])


def hyper_upper(hits: Column, drawn: Column, marked: Column, whole: Column) -> Column:
    """P(X >= hits) drawing ``drawn`` of ``whole`` with ``marked`` special; null where an argument is."""
    return _column(lambda x, *given: Drawn(*given).upper(x), hits, drawn, marked, whole)


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact p of a 2 x 2 table of counts; null where a count is."""
    return _column(lambda a, b, c, d: Drawn(a + b, a + c, a + b + c + d).two_sided(a), a, b, c, d)


def binomial_smaller_tail(hits: Column, trials: Column, share: Column) -> Column:
    """Two-sided p of :func:`binomial_two_sided`; a share of 0 or 1 gives 1 where its only count is seen, else 0."""
    def test(x: np.ndarray, n: np.ndarray, p: np.ndarray, _: np.ndarray) -> np.ndarray:
        sure = (p <= 0) | (p >= 1)
        only = np.where(p <= 0, x == 0, x == n).astype(float)
        return np.where(sure, only, binomial_two_sided(x, n, np.where(sure, 0.5, p)))

    return _column(test, hits, trials, share, F.lit(0.0))

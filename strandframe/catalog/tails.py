"""Tail probabilities in plain SQL by Simpson sums, for the comparison side."""

from __future__ import annotations


def _simpson(f: str, lo: str, hi: str, n: int) -> str:
    """Integral of ``f`` (an expression of ``u``) over [lo, hi]."""
    g = f.replace("{u}", f"({lo} + ({hi} - {lo}) * i / {n}.0::DOUBLE)")
    return f"(({hi} - {lo}) / {n}.0::DOUBLE / 3 * list_sum(list_transform(range(0, {n + 1}), lambda i: (CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {g})))"


def f_upper(f: str, d1: str, d2: str, n: int = 20000) -> str:
    ln_beta = f"(lgamma(({d1}) / 2.0) + lgamma(({d2}) / 2.0) - lgamma((({d1}) + ({d2})) / 2.0))"
    density = f"exp((({d2}) - 1) * ln(greatest(sin({{u}}), 1e-300)) + (({d1}) - 1) * ln(greatest(cos({{u}}), 1e-300)) - {ln_beta})"
    top = f"asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({f}))::DOUBLE))"
    return f"least(1.0, 2 * {_simpson(density, '0.0::DOUBLE', top, n)})"


def t_two_sided(t: str, df: str, n: int = 20000) -> str:
    return f_upper(f"({t}) * ({t})", "1", df, n)


def chi2_upper(x: str, k: str, n: int = 4000) -> str:
    density = f"exp((({k}) - 1) * ln(greatest({{u}}, 1e-300)) - {{u}} * {{u}} / 2 - (({k}) / 2.0 - 1) * ln(2) - lgamma(({k}) / 2.0))"
    lo = f"sqrt(greatest({x}, 0.0)::DOUBLE)"
    return f"least(1.0, {_simpson(density, lo, f'({lo} + 14 + sqrt(({k})::DOUBLE))', n)})"


def normal_two_sided(z: str, n: int = 2000) -> str:
    return chi2_upper(f"({z}) * ({z})", "1", n)

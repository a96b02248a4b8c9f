"""Tail probabilities in closed form, for statistics that Spark has computed."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt


def normal_sf(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * erfc(z / sqrt(2))


def wilcoxon_greater(w_plus: float, n: int, ties: float = 0.0) -> float:
    """One-sided p of the signed-rank sum over n non-zero differences; ties is the sum of t^3-t over tied groups."""
    if n == 0:
        return 1.0
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return normal_sf((w_plus - mean) / sqrt(var)) if var > 0 else 1.0


def mann_whitney_greater(u: float, n1: int, n2: int, ties: float = 0.0) -> float:
    """One-sided p of U with tie and continuity correction."""
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - (ties / (n * (n - 1)) if n > 1 else 0))
    return normal_sf((u - n1 * n2 / 2 - 0.5) / sqrt(var)) if var > 0 else 1.0


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the incomplete beta function's continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def spearman_two_sided(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation by the t distribution."""
    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else 1.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return beta_cdf((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))

"""Tail probabilities in NumPy: normal, Student t, chi-square, exact signed ranks."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's algorithm)."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


def beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


def chi2_upper(x: float, df: float) -> float:
    """1 - regularised lower incomplete gamma."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = value = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def signed_rank_two_sided(d: np.ndarray) -> float:
    """Wilcoxon: exact for up to 50 differences without ties or zeros, else normal with
    tie correction. NaN below 6 differences or when all are equal."""
    d = np.asarray(d, float)
    d = d[np.isfinite(d)]
    if len(d) < 6 or np.all(d == d[0]):
        return float("nan")
    zeros = bool((d == 0).any())
    d = d[d != 0]
    n = len(d)
    if n == 0:
        return 1.0
    order = np.abs(d)
    values, inverse, counts = np.unique(order, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    ranks = (ends - (counts - 1) / 2)[inverse]
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    if n <= 50 and not zeros and len(values) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    return normal_two_sided((w - n * (n + 1) / 4) / math.sqrt(variance))


def mann_whitney_two_sided(u: float, n1: int, n2: int, ties: float = 0.0) -> float:
    """Normal tail with tie and continuity correction; ties: sum of t^3 - t."""
    n = n1 + n2
    variance = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    return min(1.0, normal_two_sided(max(0.0, abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(variance))) if variance > 0 else 1.0


def likelihood_ratio(lr: float) -> float:
    """Upper chi-square tail with one degree of freedom."""
    return math.erfc(math.sqrt(max(lr, 0.0) / 2))

"""Tails and inverses of distributions, for finished aggregates.

Written from the usual series and continued fractions of the incomplete gamma and
beta functions; each call sees one number.
"""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()
_TINY = 1e-300


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p) if 0 < p < 1 else math.copysign(math.inf, p - 0.5) if p in (0, 1) else math.nan


def norm_pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + an * d or _TINY)
            c = 1 + an / c or _TINY
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h / a


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def t_sf2(t: float, df: float) -> float:
    """Both tails beyond abs(t)."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_ppf(p: float, df: float) -> float:
    """Quantile by bisection on the tail."""
    if p == 0.5:
        return 0.0
    want, low, high = 2 * min(p, 1 - p), 0.0, 1.0
    while t_sf2(high, df) > want:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf2(mid, df) > want else (low, mid)
    return math.copysign((low + high) / 2, p - 0.5)


def kolmogorov_sf(x: float) -> float:
    if x <= 0:
        return 1.0
    return min(1.0, max(0.0, 2 * math.fsum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))))


def bisect(f, low: float, high: float, steps: int = 200) -> float | None:
    """Root of a function with a change of sign between low and high."""
    a, b = f(low), f(high)
    if math.isnan(a) or math.isnan(b) or a * b > 0:
        return None
    for _ in range(steps):
        mid = (low + high) / 2
        c = f(mid)
        if c == 0:
            return mid
        low, high, a = (mid, high, c) if a * c > 0 else (low, mid, a)
    return (low + high) / 2

"""Finishers: from a recipe's aggregates to its value, by distributions and solvers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from . import special as sp

FINISHERS: dict[str, Callable[..., float | None]] = {}


def finisher(f: Callable[..., float | None]) -> Callable[..., float | None]:
    FINISHERS[f.__name__] = f
    return f


# --- returns --------------------------------------------------------------------


@finisher
def gaussian_var(mean: float, sd: float, level: float) -> float | None:
    return -(mean + sp.norm_ppf(1 - level) * sd) if 0.5 < level < 1 else None


@finisher
def gaussian_es(mean: float, sd: float, level: float) -> float | None:
    return -(mean - sd * sp.norm_pdf(sp.norm_ppf(1 - level)) / (1 - level)) if 0.5 < level < 1 else None


@finisher
def psr(sr: float, n: float, skew: float, excess: float, target: float) -> float | None:
    spread = 1 - skew * sr + (excess + 2) / 4 * sr * sr
    return sp.norm_cdf((sr - target) * math.sqrt(n - 1) / math.sqrt(spread)) if n >= 3 and spread > 0 else None


@finisher
def deflated(sr: float, n: float, skew: float, excess: float, trials: float, var_sr: float) -> float | None:
    if trials < 2 or var_sr < 0:
        return None
    gamma = 0.57721566490153286  # Euler's constant
    best = math.sqrt(var_sr) * ((1 - gamma) * sp.norm_ppf(1 - 1 / trials) + gamma * sp.norm_ppf(1 - 1 / (trials * math.e)))
    return psr(sr, n, skew, excess, best)


@finisher
def cornish_fisher(mean: float, sd: float, skew: float, excess: float, level: float, n: float) -> float | None:
    if n < 4 or not 0.5 < level < 1:
        return None
    z = sp.norm_ppf(1 - level)
    bent = z + (z**2 - 1) * skew / 6 + (z**3 - 3 * z) * excess / 24 - (2 * z**3 - 5 * z) * skew**2 / 36
    return -(mean + bent * sd)


@finisher
def modified_sharpe(mean: float, sd: float, skew: float, excess: float, level: float, n: float) -> float | None:
    risk = cornish_fisher(mean, sd, skew, excess, level, n)
    return mean / risk if risk and risk > 0 else None


def _xlogp(n: float, p: float) -> float:
    return n * math.log(p) if n else 0.0


def _coverage_lr(n: float, x: float, p0: float) -> float:
    rate = x / n
    return max(0.0, -2 * (_xlogp(n - x, 1 - p0) + _xlogp(x, p0) - _xlogp(n - x, 1 - rate) - _xlogp(x, rate)))


def _markov_lr(n00: float, n01: float, n10: float, n11: float) -> float:
    zeros, ones = n00 + n01, n10 + n11
    rate = (n01 + n11) / (zeros + ones)
    after0, after1 = n01 / zeros if zeros else 0.0, n11 / ones if ones else 0.0
    apart = _xlogp(n00, 1 - after0) + _xlogp(n01, after0) + _xlogp(n10, 1 - after1) + _xlogp(n11, after1)
    return max(0.0, -2 * (_xlogp(n00 + n10, 1 - rate) + _xlogp(n01 + n11, rate) - apart))


@finisher
def kupiec(n: float, x: float, p0: float) -> float | None:
    return sp.chi2_sf(_coverage_lr(n, x, p0), 1) if n and 0 < p0 < 1 else None


@finisher
def markov(n00: float, n01: float, n10: float, n11: float) -> float | None:
    return sp.chi2_sf(_markov_lr(n00, n01, n10, n11), 1) if n00 + n01 + n10 + n11 else None


@finisher
def coverage(n00: float, n01: float, n10: float, n11: float, n: float, x: float, p0: float) -> float | None:
    if not n00 + n01 + n10 + n11 or not 0 < p0 < 1:
        return None
    return sp.chi2_sf(_coverage_lr(n, x, p0) + _markov_lr(n00, n01, n10, n11), 2)


# --- tests ----------------------------------------------------------------------


@finisher
def chi2(x: float, df: float) -> float | None:
    return sp.chi2_sf(x, df) if df >= 1 else None


@finisher
def f_tail(f: float, d1: float, d2: float) -> float | None:
    return sp.f_sf(f, d1, d2) if d1 >= 1 and d2 >= 1 else None


@finisher
def two_sample(ma: float, mb: float, va: float, vb: float, na: float, nb: float, kind: str) -> float | None:
    if na < 2 or nb < 2:
        return None
    ea, eb = va / na, vb / nb
    if kind == "pooled":
        spread, df = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb), na + nb - 2
    else:
        spread, df = ea + eb, (ea + eb) ** 2 / (ea * ea / (na - 1) + eb * eb / (nb - 1))
    t = (ma - mb) / math.sqrt(spread)
    return 2 * sp.norm_sf(abs(t)) if kind == "z" else sp.t_sf2(t, df)


@finisher
def effect(ma: float, mb: float, va: float, vb: float, na: float, nb: float, kind: str) -> float | None:
    if na < 2 or nb < 2:
        return None
    if kind == "glass_delta":
        return (ma - mb) / math.sqrt(vb)
    df = na + nb - 2
    d = (ma - mb) / math.sqrt(((na - 1) * va + (nb - 1) * vb) / df)
    return d * math.exp(math.lgamma(df / 2) - math.lgamma((df - 1) / 2)) / math.sqrt(df / 2) if kind == "hedges_g" else d


@finisher
def proportions(pa: float, pb: float, na: float, nb: float) -> float | None:
    both = (pa * na + pb * nb) / (na + nb)
    return min(1.0, 2 * sp.norm_sf(abs(pa - pb) / math.sqrt(both * (1 - both) * (1 / na + 1 / nb))))


@finisher
def rank_sum_p(u: float, na: float, nb: float, ties: float) -> float | None:
    n = na + nb
    spread = na * nb / 12 * (n + 1 - ties / (n * (n - 1)))
    return min(1.0, 2 * sp.norm_sf((abs(u - na * nb / 2) - 0.5) / math.sqrt(spread)))


@finisher
def ks_p(d: float, na: float, nb: float) -> float | None:
    return sp.kolmogorov_sf(d * math.sqrt(na * nb / (na + nb)))


@finisher
def signed_rank_p(up: float, n: float, ties: float) -> float | None:
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return min(1.0, 2 * sp.norm_sf(abs(up - n * (n + 1) / 4) / math.sqrt(spread)))


@finisher
def fisher(a: float, b: float, c: float, d: float) -> float | None:
    a, b, c, d = int(a), int(b), int(c), int(d)
    row, col, n = a + b, a + c, a + b + c + d
    if not n or min(row, n - row, col, n - col) == 0:
        return None
    chance = lambda x: math.lgamma(row + 1) - math.lgamma(x + 1) - math.lgamma(row - x + 1) + math.lgamma(n - row + 1) - math.lgamma(col - x + 1) - math.lgamma(n - row - col + x + 1)
    low, high = max(0, col - (n - row)), min(row, col)
    logs = [chance(x) for x in range(low, high + 1)]
    top = max(logs)
    weights = [math.exp(v - top) for v in logs]
    seen = weights[a - low]
    return min(1.0, math.fsum(w for w in weights if w <= seen * (1 + 1e-7)) / math.fsum(weights))


@finisher
def bartlett_p(k: float, n: float, pooled: float, logs: float, inverse: float, least: float) -> float | None:
    if k < 2 or least <= 0:
        return None
    bend = 1 + (inverse - 1 / (n - k)) / (3 * (k - 1))
    return sp.chi2_sf(((n - k) * math.log(pooled / (n - k)) - logs) / bend, k - 1)


@finisher
def half_width(sd: float, n: float, level: float, kind: str) -> float | None:
    if n < 2 or not 0 < level < 1:
        return None
    upper = 0.5 + level / 2
    return (sp.norm_ppf(upper) if kind == "z" else sp.t_ppf(upper, n - 1)) * sd / math.sqrt(n)


@finisher
def wilson(rate: float, n: float, level: float, sign: float) -> float | None:
    z = sp.norm_ppf(0.5 + level / 2)
    return (rate + z * z / (2 * n) + sign * z * math.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))) / (1 + z * z / n)


@finisher
def durbin_levinson(lags, rho) -> float | None:
    """Last reflection coefficient of the autocorrelations."""
    r = [v for _, v in sorted(zip(lags, rho, strict=True))]
    phi: list[float] = []
    for k, now in enumerate(r):
        left = 1 - math.fsum(a * b for a, b in zip(phi, r, strict=False))
        last = (now - math.fsum(a * b for a, b in zip(phi, reversed(r[:k]), strict=True))) / left
        phi = [a - last * b for a, b in zip(phi, reversed(phi), strict=True)] + [last]
    return phi[-1] if phi else None


@finisher
def neutral_corr(eras, predictions, targets, first, second) -> float | None:
    """Mean over eras: predictions as normal scores, made orthogonal to the features, against the target."""
    rows: dict[str, list[tuple]] = {}
    for era, *rest in zip(eras, predictions, targets, first, second, strict=True):
        rows.setdefault(era, []).append(rest)
    found = []
    for era in sorted(rows):
        p, y, f1, f2 = np.array(rows[era], float).T
        if len(p) < 2:
            continue
        score = _normal_scores(p, 1e-12)
        design = np.column_stack([f1, f2, np.ones(len(p))])
        rest = score - design @ np.linalg.lstsq(design, score, rcond=None)[0]
        again = _normal_scores(rest, 1e-6)
        power = lambda x: np.sign(x) * np.abs(x) ** 1.5
        found.append(float(np.corrcoef(power(again), power(y - y.mean()))[0, 1]))
    return sum(found) / len(found) if found else None


def _normal_scores(x: np.ndarray, least: float) -> np.ndarray:
    """Normal scores of mean ranks, each rank's once."""
    ranks, at = np.unique(_mean_ranks(x), return_inverse=True)
    return np.array([sp.norm_ppf(q) for q in np.clip((ranks - 0.5) / len(x), least, 1 - least)])[at]


def _mean_ranks(x: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


# --- solvers --------------------------------------------------------------------


#: ln(1 + rate) of rates from -99.99 % to 10^6.
LEAST_LOG_RATE, MOST_LOG_RATE = math.log(1e-4), math.log1p(1e6)


@finisher
def solve_irr(flows, times, last: float) -> float | None:
    """Rate at which dated flows are worth nothing; ``last`` joins the latest flow.

    The unknown is u = ln(1 + rate). Only the sign of the worth matters, so it is
    scaled by the largest discount factor and never overflows. The root nearest to
    a rate of nothing is looked for, in ever wider steps on both sides.
    """
    begin, end = min(times), max(times)
    dated = [(cf + (last if k == end else 0), k) for cf, k in zip(flows, times, strict=True)]
    if not any(cf > 0 for cf, _ in dated) or not any(cf < 0 for cf, _ in dated):
        return None

    def worth(u: float) -> float:
        return math.fsum(cf * math.exp(-u * (k - (begin if u > 0 else end))) for cf, k in dated)

    low = high = 0.0
    step, here = 1 / 64, worth(0.0)
    if here == 0:
        return 0.0
    while True:
        down, up = max(low - step, LEAST_LOG_RATE), min(high + step, MOST_LOG_RATE)
        for a, b in ((high, up), (down, low)):
            if a < b and worth(a) * worth(b) <= 0:
                return math.expm1(sp.bisect(worth, a, b))
        if (down, up) == (low, high):
            return None
        low, high, step = down, up, 2 * step


@finisher
def solve_yield(flows, times, price: float) -> float | None:
    return sp.bisect(lambda y: math.fsum(cf / (1 + y) ** t for cf, t in zip(flows, times, strict=True)) - price, -0.9999, 10.0) if price > 0 else None


@finisher
def solve_spread(flows, rates, times, price: float) -> float | None:
    worth = lambda s: math.fsum(cf / (1 + z + s) ** t for cf, z, t in zip(flows, rates, times, strict=True)) - price
    return sp.bisect(worth, -0.5, 5.0) if price > 0 and min(rates) > -1 else None

"""Row functions that SQL lacks, as Arrow-batched functions of the session."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import special as sp

_ARTICLES = frozenset(("a", "an", "the"))


def _lcs(a, b) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _edits(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def _normalised(text: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w not in _ARTICLES]


def token_f1_score(p: str, r: str) -> float:
    a, b = _normalised(p), _normalised(r)
    if not a or not b:
        return float(a == b)
    shared = sum((Counter(a) & Counter(b)).values())
    return 2 * shared / (len(a) + len(b))


def indel_score(p: str, r: str) -> float:
    return 2 * _lcs(p, r) / (len(p) + len(r)) if p or r else 1.0


def jaro_score(p: str, r: str) -> float:
    if not p or not r:
        return float(p == r)
    reach, free, mine = max(len(p), len(r)) // 2 - 1, [True] * len(r), []
    for i, c in enumerate(p):
        for j in range(max(0, i - reach), min(len(r), i + reach + 1)):
            if free[j] and r[j] == c:
                free[j] = False
                mine.append(c)
                break
    theirs = [c for c, f in zip(r, free, strict=True) if not f]
    m = len(mine)
    swapped = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    return (m / len(p) + m / len(r) + (m - swapped) / m) / 3 if m else 0.0


def jaro_winkler_score(p: str, r: str) -> float:
    j = jaro_score(p, r)
    same = 0
    for x, y in zip(p[:4], r[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j) if j > 0.7 else j


def implied_vol(spot: float, strike: float, t: float, rate: float, price: float, call: float) -> float | None:
    if min(spot, strike, t, price) <= 0:
        return None

    def gap(vol: float) -> float:
        d1 = (math.log(spot / strike) + (rate + vol * vol / 2) * t) / (vol * math.sqrt(t))
        d2 = d1 - vol * math.sqrt(t)
        sign = 1 if call == 1 else -1
        return sign * (spot * sp.norm_cdf(sign * d1) - strike * math.exp(-rate * t) * sp.norm_cdf(sign * d2)) - price

    return sp.bisect(gap, 1e-6, 10.0, 100)


#: name -> (function of one row, arguments)
ROW_FUNCTIONS: dict[str, tuple[Callable, int]] = {
    "norm_cdf": (sp.norm_cdf, 1),
    "norm_ppf": (sp.norm_ppf, 1),
    "implied_vol": (implied_vol, 6),
    "token_edits": (lambda p, r: float(_edits(r.split(), p.split())), 2),
    "token_f1_score": (token_f1_score, 2),
    "indel_score": (indel_score, 2),
    "jaro_score": (jaro_score, 2),
    "jaro_winkler_score": (jaro_winkler_score, 2),
    "lcs_length": (lambda p, r: float(_lcs(p, r)), 2),
}
_CALL = re.compile(rf"\b({'|'.join(ROW_FUNCTIONS)})\(")


def used(text: str) -> set[str]:
    return set(_CALL.findall(text))


def _series(f: Callable) -> Callable:
    def rows(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in x) else f(*x) for x in zip(*columns, strict=True)], dtype="float64")

    return rows


def _one(f: Callable) -> Callable:
    run = _series(f)

    def apply(a: pd.Series) -> pd.Series:
        return run(a)

    return apply


def _two(f: Callable) -> Callable:
    run = _series(f)

    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return apply


def _six(f: Callable) -> Callable:
    run = _series(f)

    def apply(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, g: pd.Series) -> pd.Series:
        return run(a, b, c, d, e, g)

    return apply


def register(spark: SparkSession, names: set[str]) -> None:
    """Make the functions known to the session under their names."""
    shape = {1: _one, 2: _two, 6: _six}
    for name in names:
        f, n = ROW_FUNCTIONS[name]
        spark.udf.register(name, F.pandas_udf(shape[n](f), "double"))
